"""Queries of the claim log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import claims as O
from ..storage import shared_folder, written
from .registry import query

ASSERTS = """
asr AS (SELECT sha256(topic_key || chr(0) || claim_subject || chr(0) || event_id) AS claim_id, sha256(topic_key || chr(0) || claim_subject || chr(0) || value) AS fp, topic_key, claim_subject, value, event_id AS source_event_id, ts
  FROM ob WHERE kind <> 'tombstone-deleted'),
gone AS (SELECT DISTINCT claim_id FROM asr JOIN ob t ON t.kind = 'tombstone-deleted' AND t.supersedes_event_id = asr.source_event_id),
win AS (SELECT * FROM (SELECT topic_key, claim_subject, claim_id AS winner, row_number() OVER (PARTITION BY topic_key, claim_subject ORDER BY ts DESC, claim_id) AS rn FROM asr WHERE claim_id NOT IN (SELECT claim_id FROM gone)) WHERE rn = 1),
st AS (SELECT asr.*, CASE WHEN claim_id IN (SELECT claim_id FROM gone) THEN 'tombstone' WHEN claim_id = winner THEN 'current' ELSE 'superseded' END AS stance, winner FROM asr LEFT JOIN win USING (topic_key, claim_subject))"""
RANDOM = "CAST(('0x' || substr(claim_id, 1, 4)) AS INT)"


def with_claims(sql, more=""):
    return views.with_views("ob", f"WITH {ASSERTS}{more} {sql}")


def parts(spark, sf):
    o = views.observations(spark, sf)
    a = O.extract(o)
    return o, a, O.tombstones(o, a)


def state(spark, sf):
    _, a, gone = parts(spark, sf)
    return O.elect(a, gone)


@query("w1_current_election", with_claims("SELECT claim_id, stance, CASE WHEN stance = 'superseded' THEN winner END AS superseded_by FROM st"))
def w1(spark, sf):
    return state(spark, sf).select("claim_id", "stance", "superseded_by")


@query("j1_tombstone_targets", with_claims("SELECT claim_id, 'tombstone_deleted' AS reason FROM gone"))
def j1(spark, sf):
    return parts(spark, sf)[2]


def log(spark, sf):
    """Every claim is asserted, and each third corrected later to another value."""
    _, a, _ = parts(spark, sf)
    ord_ = F.col("source_event_id").cast("long")
    first = a.withColumn("ord", ord_).withColumn("ingested_at", F.concat(F.lit("run1-"), "source_event_id"))
    again = a.where(ord_ % 3 == 0).withColumn("ord", ord_ + 10_000_000).withColumn("ingested_at", F.lit("run2")).withColumn("value", F.concat("value", F.lit("*")))
    return first.unionByName(again).withColumn("event_type", F.lit("assert"))


@query("w2_last_write_wins", with_claims("SELECT claim_id, CASE WHEN CAST(source_event_id AS BIGINT) % 3 = 0 THEN value || '*' ELSE value END AS value, 'run1-' || source_event_id AS ingested_at FROM asr"))
def w2(spark, sf):
    return O.last_writes(log(spark, sf)).select("claim_id", "value", "ingested_at")


STRICT = "slots AS (SELECT topic_key, claim_subject FROM asr GROUP BY 1, 2 HAVING count(DISTINCT ts) = count(*))"


def strict(a):
    slots = a.groupBy(*O.SLOT).agg((F.countDistinct("ts") == F.count(F.lit(1))).alias("ok")).where("ok").select(*O.SLOT)
    return a.join(slots, O.SLOT, "left_semi")


LAG = f"""SELECT old, "new" FROM (SELECT lag(claim_id) OVER w AS old, claim_id AS "new", lag(fp) OVER w AS ofp, fp FROM asr SEMI JOIN slots USING (topic_key, claim_subject) WINDOW w AS (PARTITION BY topic_key, claim_subject ORDER BY ts, source_event_id)) WHERE old IS NOT NULL AND ofp <> fp"""


@query("w3_supersede_lag", with_claims(LAG, f", {STRICT}"))
def w3(spark, sf):
    return O.transitions(strict(parts(spark, sf)[1])).select("old", "new")


@query("w3_supersede_fold", with_claims(LAG, f", {STRICT}"))
def w3_fold(spark, sf):
    return O.fold(strict(parts(spark, sf)[1]))


def moves_sql(asserts: str, state: str | None = None) -> str:
    """The fold in SQL: of a slot's events of one time the first by id takes it, and the others lose to it. What is not after the state before loses to that."""
    events = f"SELECT a.*, {'s.claim_id' if state else 'NULL'} AS sc, {'s.fp' if state else 'NULL'} AS sf, {'coalesce(a.ts <= s.ts, false)' if state else 'false'} AS late FROM {asserts} a" + (f" LEFT JOIN {state} s USING (topic_key, claim_subject)" if state else "")
    return f"""ev AS ({events}),
gr AS (SELECT *, first_value(claim_id) OVER w AS fc, first_value(fp) OVER w AS ff, row_number() OVER w AS rn FROM ev WHERE NOT late WINDOW w AS (PARTITION BY topic_key, claim_subject, ts ORDER BY source_event_id)),
hd AS (SELECT *, lag(claim_id, 1, sc) OVER w AS pc, lag(fp, 1, sf) OVER w AS pf FROM gr WHERE rn = 1 WINDOW w AS (PARTITION BY topic_key, claim_subject ORDER BY ts)),
mv AS (SELECT pc AS old, claim_id AS "new" FROM hd WHERE pf <> fp UNION ALL SELECT claim_id, fc FROM gr WHERE rn > 1 AND ff <> fp UNION ALL SELECT claim_id, sc FROM ev WHERE late AND sf <> fp)"""


LATE = """
a1 AS (SELECT * FROM asr WHERE ts >= 870000000),
s1 AS (SELECT * FROM asr WHERE ts < 880000000 QUALIFY row_number() OVER (PARTITION BY topic_key, claim_subject ORDER BY ts DESC, claim_id) = 1)"""


@query("st5_late_events", with_claims('SELECT old, "new" FROM mv', f", {LATE}, {moves_sql('a1', 's1')}"))
def st5(spark, sf):
    """The fold over all slots, ties and late arrivals included, after a state before."""
    _, a, _ = parts(spark, sf)
    before = O.elect(a.where("ts < 880000000"), a.limit(0)).where("stance = 'current'")
    return O.fold(a.where("ts >= 870000000"), before)


OVERRIDES = """
ov AS (SELECT ord, CASE WHEN ord % 4 = 3 THEN 'restore' ELSE 'retract' END AS op, CASE WHEN ord % 2 = 0 THEN 'event_id' ELSE 'claim_id' END AS key_type, CASE WHEN ord % 2 = 0 THEN source_event_id ELSE claim_id END AS key
  FROM (SELECT *, CAST(source_event_id AS BIGINT) AS ord FROM asr WHERE CAST(source_event_id AS BIGINT) % 5 = 0)),
ov2 AS (SELECT * FROM ov UNION ALL SELECT ord + 10000000, 'restore', key_type, key FROM ov WHERE ord % 15 = 0),
lst AS (SELECT key_type, key, arg_max(op, ord) AS op FROM ov2 GROUP BY 1, 2)"""


def override_log(a):
    ord_ = F.col("source_event_id").cast("long")
    base = a.where(ord_ % 5 == 0).select(
        ord_.alias("ord"), F.when(ord_ % 4 == 3, "restore").otherwise("retract").alias("op"), F.when(ord_ % 2 == 0, "event_id").otherwise("claim_id").alias("key_type"),
        F.when(ord_ % 2 == 0, F.col("source_event_id")).otherwise(F.col("claim_id")).alias("key"))
    return base.union(base.where("ord % 15 = 0").select(F.col("ord") + 10_000_000, F.lit("restore"), "key_type", "key"))


@query("w4_override_resolution", with_claims("SELECT * FROM lst", f", {OVERRIDES}"))
def w4(spark, sf):
    return O.resolve_overrides(override_log(parts(spark, sf)[1]))


@query("j11_overrides", with_claims("""SELECT DISTINCT claim_id FROM (
  SELECT claim_id FROM asr JOIN lst ON key_type = 'event_id' AND key = source_event_id AND op = 'retract' UNION SELECT claim_id FROM asr JOIN lst ON key_type = 'claim_id' AND key = claim_id AND op = 'retract'
  UNION SELECT claim_id FROM asr JOIN (VALUES ('customer:1', 'order-status', '^[FO]$'), ('customer:2', 'order-status', 'P')) p(t, s, re) ON topic_key = t AND claim_subject = s AND regexp_matches(value, re))
WHERE claim_id NOT IN (SELECT key FROM lst WHERE key_type = 'claim_id' AND op = 'restore')""", f", {OVERRIDES}"))
def j11(spark, sf):
    a = parts(spark, sf)[1]
    predicates = spark.createDataFrame([("customer:1", "order-status", "^[FO]$"), ("customer:2", "order-status", "P")], "topic_key string, claim_subject string, value_pattern string")
    return O.overridden(a, override_log(a), predicates)


@query("a18_fingerprint_groups", with_claims("SELECT fp, count(*) AS n, min(claim_id) AS first FROM asr GROUP BY 1"))
def a18(spark, sf):
    return O.groups(parts(spark, sf)[1])


@query("sk5_reconcile", with_claims("SELECT coalesce(d.name, p.name) AS name, CASE WHEN d.name IS NULL THEN 'delete' WHEN p.name IS NULL OR d.sha <> p.sha THEN 'write' ELSE 'skip' END AS action FROM (SELECT topic_key AS name, sha256(value) AS sha FROM st WHERE stance = 'current') d FULL JOIN (SELECT topic_key AS name, CASE WHEN length(topic_key) % 2 = 0 THEN sha256(value) ELSE 'old' END AS sha FROM asr WHERE ts < 900000000 QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY ts DESC, source_event_id DESC) = 1) p ON d.name = p.name"))
def sk5(spark, sf):
    _, a, _ = parts(spark, sf)
    desired = state(spark, sf).where("stance = 'current'").select(F.col("topic_key").alias("name"), F.sha2("value", 256).alias("sha"))
    old = a.where("ts < 900000000").groupBy("topic_key").agg(F.max_by("value", F.struct("ts", "source_event_id")).alias("value"))
    present = old.select(F.col("topic_key").alias("name"), F.when(F.length("topic_key") % 2 == 0, F.sha2("value", 256)).otherwise("old").alias("sha"))
    return O.reconcile(desired, present)


APPLIED = """
want AS (SELECT topic_key AS name, sha256(value) AS sha FROM st WHERE stance = 'current'),
have AS (SELECT topic_key AS name, CASE WHEN length(topic_key) % 2 = 0 THEN sha256(value) ELSE 'old' END AS sha FROM asr WHERE ts < 900000000
  QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY ts DESC, source_event_id DESC) = 1)"""


def applied(spark, sf):
    """A projection written over an older one, and once more: the table, and what each of the three rounds did."""
    from ..sources.store import Store

    _, a, _ = parts(spark, sf)
    desired = written(state(spark, sf).where("stance = 'current'").select(F.col("topic_key").alias("name"), F.sha2("value", 256).alias("sha")))
    old = a.where("ts < 900000000").groupBy("topic_key").agg(F.max_by("value", F.struct("ts", "source_event_id")).alias("value"))
    present = old.select(F.col("topic_key").alias("name"), F.when(F.length("topic_key") % 2 == 0, F.sha2("value", 256)).otherwise("old").alias("sha"))
    store = Store(spark, f"{shared_folder(spark)}/projection", desired.schema, "name", buckets=16)
    return store, [store.sync(rows) for rows in (present, desired, desired)]


@query("sk5_applied", with_claims("SELECT name, sha FROM want", f", {APPLIED}"))
def sk5_applied(spark, sf):
    return applied(spark, sf)[0].rows()


@query("sk5_rounds", with_claims("""SELECT 1 AS round, count(*) AS written, 0 AS deleted, 0 AS kept FROM have
UNION ALL SELECT 2, count(*) FILTER (w.name IS NOT NULL AND h.sha IS DISTINCT FROM w.sha), count(*) FILTER (w.name IS NULL), count(*) FILTER (h.sha = w.sha) FROM want w FULL JOIN have h ON w.name = h.name
UNION ALL SELECT 3, 0, 0, count(*) FROM want""", f", {APPLIED}"))
def sk5_rounds(spark, sf):
    """Rows that each round wrote, deleted and left; the last finds nothing to do, and writes no version."""
    store, rounds = applied(spark, sf)
    if store.manifests.latest() != 2:
        raise ValueError("a round without changes has written a version")
    return spark.createDataFrame([(k, r["written"], r["deleted"], r["kept"]) for k, r in enumerate(rounds, 1)], "round int, written long, deleted long, kept long")


MESSY = """
me AS (SELECT *, CASE WHEN CAST(event_id AS BIGINT) % 31 = 0 THEN 2 ELSE 1 END AS schema_version, CAST(event_id AS BIGINT) % 37 = 0 AS noval, CAST(event_id AS BIGINT) % 41 = 0 AS nots FROM ob),
gd AS (SELECT * FROM me WHERE schema_version = 1 AND NOT noval AND NOT nots),
as2 AS (SELECT asr.* FROM asr SEMI JOIN gd ON gd.event_id = asr.source_event_id),
go2 AS (SELECT DISTINCT claim_id FROM as2 JOIN gd t ON t.kind = 'tombstone-deleted' AND t.supersedes_event_id = as2.source_event_id),
cu2 AS (SELECT * FROM as2 WHERE claim_id NOT IN (SELECT claim_id FROM go2) QUALIFY row_number() OVER (PARTITION BY topic_key, claim_subject ORDER BY ts DESC, claim_id) = 1)"""


def consolidated(spark, sf):
    """A dry run, a run, and a run on the same events again, of which none is after the watermark: the memory and the counters."""
    from ..operators.consolidate import Memory, consolidate

    n = F.col("event_id").cast("long")
    o = views.observations(spark, sf).withColumn("schema_version", F.when(n % 31 == 0, 2).otherwise(1)).withColumn("value", F.when(n % 37 == 0, " ").otherwise(F.col("value"))).withColumn("ts", F.when(n % 41 != 0, F.col("ts")))
    memory = Memory(spark, f"{shared_folder(spark)}/memory")
    return memory, [consolidate(memory, o, dry_run=dry) for dry in (True, False, False)]


COUNTERS = """
c AS (SELECT (SELECT count(*) FROM me) AS events_total, (SELECT count(*) FROM gd) AS events_conforming, (SELECT count(*) FROM me WHERE schema_version > 1) AS events_skipped_future_schema,
  (SELECT count(*) FROM me WHERE schema_version = 1 AND noval) + (SELECT count(*) FROM gd WHERE kind = 'tombstone-deleted' AND supersedes_event_id IS NULL) AS events_skipped_missing_required,
  (SELECT count(*) FROM me WHERE schema_version = 1 AND NOT noval AND nots) AS events_skipped_unparseable_ts, (SELECT count(*) FROM as2) AS claims_asserted,
  (SELECT count(*) FROM mv) AS supersedes_appended, (SELECT count(*) FROM go2) AS retracts_appended, (SELECT count(*) FROM cu2) AS shown)"""
_SKIPPED = "events_skipped_future_schema, {0} AS events_skipped_missing_required, events_skipped_unparseable_ts"


@query("st8_counters", with_claims(f"""SELECT 1 AS round, events_total, events_conforming, {_SKIPPED.format('events_skipped_missing_required')}, claims_asserted, supersedes_appended, retracts_appended, 0 AS overrides_applied, 0 AS re_election_supersedes, 0 AS projection_written, 0 AS projection_unchanged, 0 AS projection_orphans_deleted FROM c
UNION ALL SELECT 2, events_total, events_conforming, {_SKIPPED.format('events_skipped_missing_required')}, claims_asserted, supersedes_appended, retracts_appended, 0, 0, shown, 0, 0 FROM c
UNION ALL SELECT 3, events_total, 0, {_SKIPPED.format('(SELECT count(*) FROM me WHERE schema_version = 1 AND noval)')}, 0, 0, 0, 0, 0, 0, shown, 0 FROM c""", f", {MESSY}, {moves_sql('as2')}, {COUNTERS}"))
def st8_counters(spark, sf):
    _, rounds = consolidated(spark, sf)
    schema = "round int, " + ", ".join(f"{k} long" for k in rounds[0])
    return spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rounds, 1)], schema)


@query("st8_state", with_claims("""SELECT claim_id, CASE WHEN claim_id IN (SELECT claim_id FROM go2) THEN 'tombstone' WHEN claim_id IN (SELECT claim_id FROM cu2) THEN 'current' ELSE 'superseded' END AS stance FROM as2""", f", {MESSY}"))
def st8_state(spark, sf):
    """The state after the runs, elected from the store."""
    rows = consolidated(spark, sf)[0].claims.rows()
    return O.elected(rows).select("claim_id", "stance")


@query("t12_presorted_batch", views.with_views("ob", "SELECT event_id FROM (SELECT * FROM ob ORDER BY ts, CASE WHEN kind LIKE 'tombstone%' THEN 1 ELSE 0 END, event_id LIMIT 500)"))
def t12(spark, sf):
    return views.observations(spark, sf).orderBy("ts", F.col("kind").startswith("tombstone").cast("int"), "event_id").limit(500).select("event_id")


@query("st6_deferred_tombstones", with_claims("SELECT topic_key, count(*) AS claims, count(*) FILTER (stance = 'tombstone') AS deleted FROM st GROUP BY 1"))
def st6(spark, sf):
    return state(spark, sf).groupBy("topic_key").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("stance") == "tombstone").alias("deleted"))


@query("st7_idempotent_append", with_claims("SELECT claim_id FROM asr WHERE ts >= 850000000 AND claim_id NOT IN (SELECT claim_id FROM asr WHERE ts < 900000000)"))
def st7(spark, sf):
    """A batch that overlaps what is in the log adds only what is new."""
    a = parts(spark, sf)[1]
    return a.where("ts >= 850000000").join(a.where("ts < 900000000").select("claim_id"), "claim_id", "left_anti").select("claim_id")


@query("st4_watermark", views.with_views("ob", "SELECT CAST(max(ts) AS DOUBLE) AS ts, arg_max(event_id, (ts, CASE WHEN kind LIKE 'tombstone%' THEN 1 ELSE 0 END, event_id)) AS event_id, count(*) AS processed FROM ob WHERE ts < 900000000"))
def st4(spark, sf):
    mark = F.struct("ts", F.col("kind").startswith("tombstone").cast("int"), "event_id")
    return views.observations(spark, sf).where("ts < 900000000").agg(F.max("ts").alias("ts"), F.max_by("event_id", mark).alias("event_id"), F.count(F.lit(1)).alias("processed"))
