"""Replay of context-budget state: items held in capped buckets, evicted by a policy.

The fold over a session's events is sequential by nature. Events are dealt by session and sorted, and a
task folds them as they stream by: it holds the items in force, never a session's events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import fold

#: Caps of the default configuration; the bucket that does not count as used.
BUDGETS = {"claude_md": 4000, "hot": 2000, "retrieved": 6000}
UNCOUNTED = "claude_md"


@dataclass(frozen=True)
class Item:
    id: str
    bucket: str
    tokens: int
    touched: int = 0
    pinned: bool = False
    score: float = 0.0


#: Policies: the order in which items of a bucket that are not pinned are evicted.
POLICIES: dict[str, Callable[[Item], tuple]] = {
    "lru": lambda i: (i.touched, i.id),
    "pinned_first": lambda i: (i.touched, i.id),
    "recency_weighted": lambda i: (i.score, i.touched, i.id),
}


class Engine:
    """Items by id, and the turn. A session's start resets the turn, not the items. A policy is one of ``POLICIES``, or an order of one's own."""

    def __init__(self, budgets: dict[str, int], policy: str | Callable[[Item], tuple]):
        self.budgets, self.order = budgets, POLICIES[policy] if isinstance(policy, str) else policy
        self.items: dict[str, Item] = {}
        self.turn = 0

    def apply(self, op: str, item: Item | None = None) -> None:
        if op == "start":
            self.turn = 0
        elif op == "turn":
            self.turn += 1
        elif op == "add":
            self.items[item.id] = replace(item, touched=self.turn)
            self._enforce(item.bucket)
        elif op == "evict":
            self.items.pop(item.id, None)
        elif item is not None and item.id in self.items:
            change = {"touch": {"touched": self.turn}, "pin": {"pinned": True}, "unpin": {"pinned": False}}.get(op, {})
            self.items[item.id] = replace(self.items[item.id], **change)

    def _enforce(self, bucket: str) -> None:
        if bucket not in self.budgets:
            return
        own = [i for i in self.items.values() if i.bucket == bucket]
        over = sum(i.tokens for i in own) - self.budgets[bucket]
        for i in sorted((i for i in own if not i.pinned), key=self.order):
            if over <= 0:
                break
            del self.items[i.id]
            over -= i.tokens

    @property
    def used(self) -> int:
        return sum(i.tokens for i in self.items.values() if i.bucket != UNCOUNTED)


def translate(events: DataFrame) -> DataFrame:
    """Engine operations (session_id, ord, sub, op, item...) of events; other kinds have none.

    Items added come before items evicted, in their order in the event.
    """
    op = F.when(F.col("event") == "SessionStart", "start").when(F.col("event") == "UserPromptSubmit", "turn")
    plain = events.where("event in ('SessionStart', 'UserPromptSubmit')").select("session_id", "ord", F.lit(0).alias("sub"), op.alias("op"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("bucket", "string"), ("tokens", "long"), ("pinned", "boolean"), ("score", "double"))])
    added = events.where("event = 'PostToolUse'").select("session_id", "ord", F.posexplode("items_added").alias("sub", "i")).select("session_id", "ord", "sub", F.lit("add").alias("op"), "i.id", "i.bucket", "i.tokens", "i.pinned", "i.score")
    named = lambda kind, name, column: events.where(f"event = '{kind}'").select("session_id", "ord", (F.lit(1000)).alias("base"), F.posexplode(column).alias("k", "id")).select("session_id", "ord", (F.col("base") + F.col("k")).alias("sub"), F.lit(name).alias("op"), "id", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "string"), ("tokens", "long"), ("pinned", "boolean"), ("score", "double"))])
    return plain.union(added).union(named("PostToolUse", "evict", "evicted")).union(named("Pin", "pin", "added_ids")).union(named("Unpin", "unpin", "evicted"))


def _fold(operations: DataFrame, schema: str, budgets: dict[str, int], policy: str, emit: Callable) -> DataFrame:
    """``emit(out, engine, session, step, held)`` sees each operation before it applies it, and None at a session's end."""

    def step(state: tuple, row: object, out: list) -> None:
        engine, session, held = state
        item = None if row.id is None else Item(row.id, row.bucket, 0 if row.tokens is None or row.tokens != row.tokens else int(row.tokens), 0, bool(row.pinned), float(row.score or 0.0))
        emit(out, engine, session, (row, item), held)

    start = lambda key: (Engine(budgets, policy), key[0], {})
    return fold(operations, ["session_id"], ["ord", "sub"], schema, start, step, lambda state, out: emit(out, state[0], state[1], None, state[2]))


def manifests(operations: DataFrame, budgets: dict[str, int] = BUDGETS, policy: str = "lru") -> DataFrame:
    """The state before each prompt but a session's first operation, and at its end."""

    def emit(out: list, engine: Engine, session: object, step: tuple | None, held: dict) -> None:
        snapshot = step is None or (held.get("some") and step[0].op == "turn")
        if snapshot:
            ids = sorted(engine.items)
            out.append((session, held.get("n", 0), engine.turn, sum(budgets.values()), engine.used, len(ids), ids))
            held["n"] = held.get("n", 0) + 1
        if step is not None:
            held["some"] = True
            engine.apply(step[0].op, step[1])

    return _fold(operations, "session_id long, seq long, turn long, budget_total long, budget_used long, n_items long, item_ids array<string>", budgets, policy, emit)


def timeline(operations: DataFrame, budgets: dict[str, int] = BUDGETS, policy: str = "lru") -> DataFrame:
    """For each event, the ids that came and went by it."""

    def close(out: list, engine: Engine, session: object, held: dict) -> None:
        if "ord" in held:
            now = set(engine.items)
            out.append((session, held["ord"], engine.turn, engine.used, sorted(now - held["before"]), sorted(held["before"] - now)))

    def emit(out: list, engine: Engine, session: object, step: tuple | None, held: dict) -> None:
        if step is None or step[0].ord != held.get("ord"):
            close(out, engine, session, held)
            if step is not None:
                held["ord"], held["before"] = step[0].ord, set(engine.items)
        if step is not None:
            engine.apply(step[0].op, step[1])

    return _fold(operations, "session_id long, ord long, turn long, budget_used long, added array<string>, evicted array<string>", budgets, policy, emit)


def churn(steps: DataFrame) -> DataFrame:
    """Evictions of each session, and items that came back after one: by explosion and a running maximum."""
    moves = steps.select("session_id", "ord", F.explode("added").alias("id"), F.lit(0).alias("gone")).union(steps.select("session_id", "ord", F.explode("evicted"), F.lit(1)))
    before = F.max(F.when(F.col("gone") == 1, F.col("ord"))).over(Window.partitionBy("session_id", "id").orderBy("ord", "gone").rowsBetween(Window.unboundedPreceding, -1))
    return moves.withColumn("last", before).groupBy("session_id").agg(F.sum("gone").alias("evictions"), F.count_if((F.col("gone") == 0) & F.col("last").isNotNull()).alias("readds"))


def diff(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Items of two manifests: added, removed or unchanged."""
    x, y = a.select(key, F.lit(1).alias("x")), b.select(key, F.lit(1).alias("y"))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("unchanged").alias("status"))


def evictions(items: DataFrame, need: str, order: list, group: list[str]) -> DataFrame:
    """What a policy evicts of (group, id, tokens, pinned): in its order, until ``need`` tokens are free, the last one included."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.where(~F.col("pinned")).withColumn("freed", before).where(F.col("freed") < F.col(need)).drop("freed")


def latest_session(events: DataFrame) -> DataFrame:
    """Events from each session's last start on."""
    start = events.where("event = 'SessionStart'").groupBy("session_id").agg(F.max("ord").alias("start"))
    return events.join(start, "session_id", "left").where(F.col("ord") >= F.coalesce("start", F.lit(0))).drop("start")


def since_last_prompt(events: DataFrame) -> DataFrame:
    """Events since each session's last prompt but one."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ord")))
    prompt = events.where("event = 'UserPromptSubmit'").withColumn("k", place).where("k = 2").select("session_id", F.col("ord").alias("since"))
    return events.join(prompt, "session_id", "left").where(F.col("ord") >= F.coalesce("since", F.lit(0))).drop("since")


def chunks(messages: DataFrame, target: int) -> DataFrame:
    """Greedy chunks of (session_id, ord, tokens) in order, closed before one would pass ``target``."""

    def step(state: list[int], m: object, out: list) -> None:
        if state[0] + m.tokens > target and state[0]:
            state[:] = [0, state[1] + 1]
        state[0] += m.tokens
        out.append((m.session_id, m.ord, state[1]))

    return fold(messages.select("session_id", "ord", "tokens"), ["session_id"], ["ord"], "session_id long, ord long, chunk long", lambda key: [0, 0], step, lambda state, out: None)
