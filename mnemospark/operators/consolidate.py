"""One consolidation run: events become rows of the claim log, the state of claims, a projection and a watermark.

The input is read once: what is left out is counted by an observation beside the job that keeps the rest, and so are the rows of the log.
Every table is a keyed store and ids are made of what they name, so a run that died is run again and changes nothing twice: the watermark
comes last, and names the version of the claims that goes with it. A dry run does the same up to the counts and writes to no store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..sources.manifest import Manifests
from ..sources.store import PACKED, Store
from ..storage import written
from . import claims as C
from .ordered import fold

CLAIM = T.StructType([T.StructField(c, T.DoubleType() if c == "ts" else T.BooleanType() if c == "retracted" else T.StringType()) for c in ("claim_id", "fp", *C.SLOT, "value", "source_event_id", "ts", "retracted")])
LOG = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "event_type", "claim_id", "new_claim_id", "reason")])
SHOWN = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "claim_id", "sha")])
DELETED, EDITED = "tombstone-deleted", "tombstone-edited"


@dataclass(frozen=True)
class Memory:
    """The folder of one memory: its stores and its watermark."""

    spark: SparkSession
    folder: str

    @property
    def claims(self) -> Store:
        return Store(self.spark, f"{self.folder}/claims", CLAIM, "claim_id")

    @property
    def log(self) -> Store:
        return Store(self.spark, f"{self.folder}/log", LOG, "id")

    @property
    def projection(self) -> Store:
        return Store(self.spark, f"{self.folder}/projection", SHOWN, "name")

    @property
    def marks(self) -> Manifests:
        return Manifests(self.spark, f"{self.folder}/marks")

    def mark(self) -> dict:
        """The watermark, if there is one, and the version of the claims that goes with it. What a run that died has left is in later versions."""
        version = self.marks.latest()
        return self.marks.read(version) if version else {"watermark": None, "claims": 0}

    def watermark(self) -> dict | None:
        """ts, tombstone and event_id of the last event taken."""
        return self.mark()["watermark"]


def current(claims: DataFrame) -> DataFrame:
    """The claim of each slot that stands: one row a slot is shuffled from each task, not all claims."""
    one = F.min_by(F.struct(*[c for c in claims.columns if c not in C.SLOT]), F.struct(-F.col("ts"), "claim_id")).alias("one")
    return claims.where("not coalesce(retracted, false)").groupBy(*C.SLOT).agg(one).select(*C.SLOT, "one.*").drop("retracted")


def sorted_out(events: DataFrame, mark: dict | None) -> Column:
    """What becomes of an event: future (a schema newer than 1), missing (a field that it needs), unparseable (its time), old (not after the watermark) or good."""
    blank = lambda c: F.col(c).isNull() | (F.btrim(c) == "")
    place = F.struct(F.col("ts").alias("a"), F.col("kind").isin(DELETED, EDITED).cast("int").alias("b"), F.col("event_id").alias("c"))
    old = F.lit(False) if mark is None else place <= F.struct(F.lit(float(mark["ts"])).alias("a"), F.lit(int(mark["tombstone"])).alias("b"), F.lit(mark["event_id"]).alias("c"))
    return (
        F.when(F.coalesce(F.col("schema_version"), F.lit(1)) > 1, "future").when(blank("kind") | blank("event_id") | blank("value"), "missing")
        .when(F.col("ts").isNull(), "unparseable").when(old, "old").otherwise("good")
    )


def moves(asserts: DataFrame, before: DataFrame) -> DataFrame:
    """(old, new) as each slot's asserts come by in order after the current claims ``before``. An edit takes the slot without a conflict.

    Claims go by their events and packed fingerprints; their ids, which are made of slot and event, are made again of those that moved.
    """
    columns = [*C.SLOT, "ts", "source_event_id", F.unhex("fp").alias("fp"), "edited"]
    events = before.withColumn("edited", F.lit(False)).select(F.lit(0).alias("phase"), *columns).unionByName(asserts.select(F.lit(1).alias("phase"), *columns))

    def step(held: list, e: object, out: list) -> None:
        newer = not held or e.ts > held[2]
        if held and held[1] != e.fp and not e.edited:
            out.append((e.topic_key, e.claim_subject, *((held[0], e.source_event_id) if newer else (e.source_event_id, held[0]))))
        if newer:
            held[:] = [e.source_event_id, e.fp, e.ts]

    moved = fold(events, C.SLOT, ["phase", "ts", "source_event_id"], "topic_key string, claim_subject string, old string, new string", lambda key: [], step, lambda held, out: None)
    return moved.select(*[ids.claim_id(F.col("topic_key"), F.col("claim_subject"), F.col(c)).alias(c) for c in ("old", "new")])


def projected(standing: DataFrame) -> DataFrame:
    return standing.select(F.concat_ws("\x1f", *C.SLOT).alias("name"), "claim_id", F.sha2("value", 256).alias("sha"))


def counters(s: dict, g: dict) -> dict[str, int]:
    """The counters of a run, of what became of events and of the rows of the log."""
    return {
        "events_total": s["total"], "events_conforming": s["good"], "events_skipped_future_schema": s["future"], "events_skipped_missing_required": s["missing"] + s["aimless"], "events_skipped_unparseable_ts": s["unparseable"],
        "claims_asserted": g.get("assert", 0), "supersedes_appended": g.get("supersede", 0), "retracts_appended": g.get("retract", 0), "overrides_applied": g.get("operator", 0),
        "re_election_supersedes": 0, "projection_written": 0, "projection_unchanged": 0, "projection_orphans_deleted": 0,
    }


def consolidate(memory: Memory, events: DataFrame, overrides: DataFrame | None = None, predicates: DataFrame | None = None, dry_run: bool = False) -> dict[str, int]:
    """Takes the events after the watermark (event_id, kind, topic_key, claim_subject, value, ts, supersedes_event_id, schema_version) and returns the counters of the run.

    Tombstones are resolved when all asserts of the run are known: a deletion retracts the claims of the event it names, an edit
    supersedes those in its slot. ``overrides`` and ``predicates`` are as in ``claims.overridden``.
    """
    spark, held = memory.spark, memory.mark()
    mark = held["watermark"]
    seen = Observation()
    kind = F.col("__kind")
    counted = events.withColumn("__kind", sorted_out(events, mark)).observe(
        seen, F.count(F.lit(1)).alias("total"), *[F.count_if(kind == k).alias(k) for k in ("good", "future", "missing", "unparseable")],
        F.count_if((kind == "good") & F.col("kind").isin(DELETED, EDITED) & (F.coalesce(F.btrim("supersedes_event_id"), F.lit("")) == "")).alias("aimless"),
    )
    good = written(counted.where(kind == "good").drop("__kind", "schema_version"), PACKED)

    before = memory.claims.rows(held["claims"])  # its files stay as they are
    standing = written(current(before).select(*C.SLOT, "ts", "claim_id", "fp", "source_event_id", "value"), PACKED)
    s = seen.get
    if not s["good"] and overrides is None and not dry_run and memory.claims.manifests.latest() == held["claims"]:
        shown = memory.projection.sync(projected(standing))
        return counters(s, {}) | {"projection_written": shown["written"], "projection_unchanged": shown["kept"], "projection_orphans_deleted": shown["deleted"]}
    # Edits and deletions are few, and written, so that joins know their sizes.
    edits = written(good.where(F.col("kind") == EDITED).select(F.col("event_id").alias("source_event_id"), F.col("supersedes_event_id").alias("target"), F.lit(True).alias("edited")).distinct())
    deletions = written(good.where(F.col("kind") == DELETED).select("kind", "supersedes_event_id"))
    new = C.extract(good).join(edits, "source_event_id", "left").withColumn("edited", F.coalesce("edited", F.lit(False)))
    claims = before.drop("retracted").unionByName(new.select(*[c for c in CLAIM.names if c != "retracted"]))
    superseded = moves(new, standing).select("old", "new", F.lit("newer_source_ts").alias("reason"))
    aimed = new.where("target is not null").select(F.col("target").alias("source_event_id"), *C.SLOT, F.col("claim_id").alias("new"))
    gone = C.tombstones(deletions, claims)
    changes = superseded
    if not edits.isEmpty():
        changes = changes.union(claims.join(aimed, ["source_event_id", *C.SLOT]).where("claim_id <> new").select(F.col("claim_id").alias("old"), "new", F.lit("tombstone_edited").alias("reason")))
    if overrides is not None:
        few = predicates if predicates is not None else spark.createDataFrame([], "topic_key string, claim_subject string, value_pattern string")
        asked = C.overridden(claims, overrides, few).join(before.where("retracted").select("claim_id"), "claim_id", "left_anti")
        gone = gone.union(asked.select("claim_id", F.lit("operator").alias("reason")))

    none = F.lit(None).cast("string")
    rows = new.select(F.lit("assert").alias("event_type"), "claim_id", none.alias("new_claim_id"), none.alias("reason"))
    rows = rows.union(changes.select(F.lit("supersede"), "old", "new", "reason")).union(gone.select(F.lit("retract"), "claim_id", none, "reason"))
    logged, of = Observation(), F.col("event_type")
    counted = rows.observe(logged, *[F.count_if(of == k).alias(k) for k in ("assert", "supersede", "retract")], F.count_if((of == "retract") & (F.col("reason") == "operator")).alias("operator"))
    if dry_run:
        counted.write.format("noop").mode("overwrite").save()
        return counters(s, logged.get)
    log = written(counted, PACKED)
    out = counters(s, logged.get)
    retracted = written(log.where("event_type = 'retract'").select("claim_id").union(before.where("retracted").select("claim_id")).distinct().withColumn("retracted", F.lit(True)))
    content = [c for c in CLAIM.names if c != "retracted"]
    state = claims.join(retracted, "claim_id", "left").select(*content, F.coalesce("retracted", F.lit(False)).alias("retracted"))
    memory.claims.upsert(state)
    after = written(current(memory.claims.rows()))
    again = after.select(*C.SLOT, F.col("claim_id").alias("now")).join(standing.select(*C.SLOT, F.col("claim_id").alias("was")), C.SLOT).where("now <> was")
    again = again.select(F.lit("supersede").alias("event_type"), F.col("was").alias("claim_id"), F.col("now").alias("new_claim_id"), F.lit("override_re_election").alias("reason"))
    again = written(again)
    both = log.union(again)
    memory.log.upsert(both.select(F.sha2(F.concat_ws("\x00", "event_type", "claim_id", F.coalesce("new_claim_id", F.lit("")), F.coalesce("reason", F.lit(""))), 256).alias("id"), "*"))
    shown = memory.projection.sync(projected(after))
    out |= {"re_election_supersedes": again.count(), "projection_written": shown["written"], "projection_unchanged": shown["kept"], "projection_orphans_deleted": shown["deleted"]}
    tombstone = F.col("kind").isin(DELETED, EDITED).cast("int")
    last = good.agg(F.max(F.struct("ts", tombstone.alias("tombstone"), "event_id")).alias("m")).first()["m"]
    now = {"watermark": mark if last is None else last.asDict(), "claims": memory.claims.manifests.latest()}
    if now != held:
        memory.marks.commit(memory.marks.latest() + 1, now)
    return out


def batches(folder: str) -> Callable[[DataFrame, int], None]:
    """A handler for the batches of a stream, each a run. A batch that comes again after a failure is at or before the watermark, and changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        consolidate(Memory(batch.sparkSession, folder), batch)

    return handle
