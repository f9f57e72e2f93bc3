"""The context-budget engine as a stateful stream: the same fold as the batch replay, state kept by session."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.runtime import BUDGETS, Engine, Item

OUTPUT = "session_id long, ord long, turn long, budget_used long, n_items long"
STATE = "turn long, items string"


def steps(operations: DataFrame, budgets: dict[str, int] = BUDGETS, policy: str = "lru") -> DataFrame:
    """The state after each batch of a session's operations. Operations are folded in order within a batch.

    What is kept for a session is its items in force; a session's operations must come in order of their batches.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = Engine(budgets, policy)
        if state.exists:
            engine.turn, items = state.get
            engine.items = {i["id"]: Item(**i) for i in json.loads(items)}
        rows = pd.concat(list(frames)).sort_values(["ord", "sub"])
        for r in rows.itertuples(index=False):
            item = None if r.id is None else Item(r.id, r.bucket, 0 if pd.isna(r.tokens) else int(r.tokens), 0, False if r.pinned is None or pd.isna(r.pinned) else bool(r.pinned), 0.0 if pd.isna(r.score) else float(r.score))
            engine.apply(r.op, item)
        state.update((engine.turn, json.dumps([asdict(i) for i in engine.items.values()])))
        yield pd.DataFrame([(key[0], int(rows["ord"].max()), engine.turn, engine.used, len(engine.items))], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return operations.groupBy("session_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", "NoTimeout")
