"""The claim log: election, supersession, tombstones and operator overrides.

The log is append-only rows (ord, event_type, claim_id, fp, topic_key, claim_subject, value, source_event_id, ts, ingested_at).
State is derived from it by windows and aggregations over claims and over slots (topic, subject).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from .ordered import fold as fold_rows

SLOT = ["topic_key", "claim_subject"]


def extract(observations: DataFrame) -> DataFrame:
    """One assertion for each observation that is no deletion."""
    c = F.col
    return observations.where("kind <> 'tombstone-deleted'").select(
        ids.claim_id(c("topic_key"), c("claim_subject"), c("event_id")).alias("claim_id"), ids.fingerprint(c("topic_key"), c("claim_subject"), c("value")).alias("fp"),
        *SLOT, "value", F.col("event_id").alias("source_event_id"), "ts",
    )


def tombstones(observations: DataFrame, asserts: DataFrame) -> DataFrame:
    """Claims that deletions retract: those of the event they name, whenever it came."""
    targets = observations.where("kind = 'tombstone-deleted' and supersedes_event_id is not null").select(F.col("supersedes_event_id").alias("source_event_id")).distinct()
    return asserts.join(targets, "source_event_id", "left_semi").select("claim_id", F.lit("tombstone_deleted").alias("reason"))


def last_writes(log: DataFrame) -> DataFrame:
    """Each claim with the content of its last assertion and the ``ingested_at`` of its first."""
    last = F.max_by(F.struct("fp", *SLOT, "value", "source_event_id", "ts"), "ord").alias("c")
    return log.where("event_type = 'assert'").groupBy("claim_id").agg(last, F.min_by("ingested_at", "ord").alias("ingested_at")).select("claim_id", "c.*", "ingested_at")


def elect(claims: DataFrame, retracted: DataFrame) -> DataFrame:
    """Stance of each claim: the newest of its slot that is not retracted is current, and supersedes the others.

    Ties in time go to the lower claim id.
    """
    return elected(claims.join(retracted.select("claim_id", F.lit(True).alias("retracted")).distinct(), "claim_id", "left"))


def elected(claims: DataFrame) -> DataFrame:
    """``elect`` of claims that have their own mark, ``retracted``."""
    marked = claims.withColumn("gone", F.coalesce("retracted", F.lit(False))).drop("retracted")
    # The winner by aggregation, not by an ordered window, so that a hot slot is combined before the shuffle.
    winner = marked.where("not gone").groupBy(*SLOT).agg(F.min_by("claim_id", F.struct(-F.col("ts"), "claim_id")).alias("winner"))
    stance = F.when(F.col("gone"), "tombstone").when(F.col("claim_id") == F.col("winner"), "current").otherwise("superseded")
    return marked.join(winner, SLOT, "left").withColumn("stance", stance).withColumn("superseded_by", F.when(F.col("stance") == "superseded", F.col("winner"))).drop("gone", "winner")


def groups(claims: DataFrame) -> DataFrame:
    """Claims that state the same value, in order of their ids."""
    return claims.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first"))


def transitions(asserts: DataFrame) -> DataFrame:
    """(old, new) wherever a value gives way to a newer other value, along each slot.

    For times that grow strictly within a slot; ``fold`` handles ties and late arrivals.
    """
    order = Window.partitionBy(*SLOT).orderBy("ts", "source_event_id")
    prior = asserts.withColumn("old", F.lag("claim_id").over(order)).withColumn("old_fp", F.lag("fp").over(order))
    return prior.where("old is not null and old_fp <> fp").select("old", F.col("claim_id").alias("new"), F.lit("newer_source_ts").alias("reason"))


def fold(asserts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The general run over each slot's events in order, with the state before it (topic_key, claim_subject, claim_id, fp, ts).

    Equal values make no transition; the newer becomes current. A different value supersedes the current one if it is newer,
    and is superseded on arrival if it is not. A slot's events stream by in order.
    """
    columns = [*SLOT, "ts", "source_event_id", "claim_id", "fp"]
    events = asserts.select(F.lit(1).alias("phase"), *columns)
    if state is not None:
        before = state.select(F.lit(0).alias("phase"), *SLOT, "ts", F.lit("").alias("source_event_id"), "claim_id", "fp")
        events = before.unionByName(events)

    def step(current: list, e: object, out: list) -> None:
        if not current:
            current[:] = [e.claim_id, e.fp, e.ts]
            return
        newer = e.ts > current[2]
        if current[1] != e.fp:
            out.append((current[0], e.claim_id) if newer else (e.claim_id, current[0]))
        if newer:
            current[:] = [e.claim_id, e.fp, e.ts]

    return fold_rows(events, SLOT, ["phase", "ts", "source_event_id"], "old string, new string", lambda key: [], step, lambda current, out: None)


def resolve_overrides(log: DataFrame) -> DataFrame:
    """The last operation of each key of an override log (ord, op, key_type, key): (key_type, key, op)."""
    return log.where("op in ('retract', 'restore') and key is not null").groupBy("key_type", "key").agg(F.max_by("op", "ord").alias("op"))


def overridden(claims: DataFrame, overrides: DataFrame, predicates: DataFrame) -> DataFrame:
    """Claims that operators retract: by event, by claim, by slot and pattern of the value; restored claims excepted.

    Predicates are few and typed by hand; they meet claims by an equality join on the slot.
    """
    last = resolve_overrides(overrides)
    of = lambda kind, op: last.where((F.col("key_type") == kind) & (F.col("op") == op)).select("key")
    by_event = claims.join(of("event_id", "retract").withColumnRenamed("key", "source_event_id"), "source_event_id", "left_semi").select("claim_id")
    by_claim = claims.join(of("claim_id", "retract").withColumnRenamed("key", "claim_id"), "claim_id", "left_semi").select("claim_id")
    by_slot = claims.join(predicates, SLOT).where(F.regexp_like("value", F.col("value_pattern"))).select("claim_id")
    restored = of("claim_id", "restore").withColumnRenamed("key", "claim_id")
    return by_event.union(by_claim).union(by_slot).distinct().join(restored, "claim_id", "left_anti")


def reconcile(desired: DataFrame, present: DataFrame, key: str = "name", digest: str = "sha") -> DataFrame:
    """What a projection has to do for each name: write, skip, or delete."""
    a, b = desired.select(key, F.col(digest).alias("want")), present.select(key, F.col(digest).alias("have"))
    action = F.when(F.col("want").isNull(), "delete").when(F.col("have").isNull() | (F.col("want") != F.col("have")), "write").otherwise("skip")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))
