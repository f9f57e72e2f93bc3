"""Queries of context-budget replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views
from ..operators import runtime as O
from .registry import query

RT = """
rt AS (SELECT user_id AS session_id, event_id AS ord, CASE event_type WHEN 'signup' THEN 'SessionStart' WHEN 'view' THEN 'UserPromptSubmit' ELSE 'PostToolUse' END AS event, event_type AS kind,
  'c-' || json_extract_string(props, '$.k') AS id, CASE event_type WHEN 'click' THEN 'hot' WHEN 'purchase' THEN 'retrieved' END AS bucket, CAST(floor(value) AS BIGINT) + 1 AS tokens, user_id % 9 = 0 AND event_id % 5 = 0 AS pinned FROM events)"""


def runtime_events(spark, sf):
    e = views.table(spark, sf, "events")
    kind = F.col("event_type")
    item = F.struct(F.concat(F.lit("c-"), F.get_json_object("props", "$.k")).alias("id"), F.when(kind == "click", "hot").otherwise("retrieved").alias("bucket"), (F.floor("value") + 1).cast("long").alias("tokens"), ((F.col("user_id") % 9 == 0) & (F.col("event_id") % 5 == 0)).alias("pinned"), (F.col("value") / 100).alias("score"))
    none = F.array().cast("array<string>")
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), "ts", F.when(kind == "signup", "SessionStart").when(kind == "view", "UserPromptSubmit").otherwise("PostToolUse").alias("event"),
        F.when(kind.isin("click", "purchase"), F.array(item)).otherwise(F.filter(F.array(item), lambda x: F.lit(False))).alias("items_added"), F.when(kind == "error", F.array(item["id"])).otherwise(none).alias("evicted"), none.alias("added_ids"),
    )


@query("st1_budget_engine")
def st1(spark, sf):
    return O.manifests(O.translate(runtime_events(spark, sf)), policy="recency_weighted")


@query("st2_translate", f"WITH {RT} SELECT session_id, ord, CASE WHEN event = 'SessionStart' THEN 'start' WHEN event = 'UserPromptSubmit' THEN 'turn' WHEN kind = 'error' THEN 'evict' ELSE 'add' END AS op, CASE WHEN event = 'PostToolUse' THEN id END AS id, CASE WHEN kind IN ('click', 'purchase') THEN tokens END AS tokens FROM rt")
def st2(spark, sf):
    return O.translate(runtime_events(spark, sf)).select("session_id", "ord", "op", "id", "tokens")


@query("st3_manifests")
def st3(spark, sf):
    return O.manifests(O.translate(runtime_events(spark, sf)))


@query("w11_timeline")
def w11(spark, sf):
    return O.timeline(O.translate(runtime_events(spark, sf)))


@query("a25_churn")
def a25(spark, sf):
    return O.churn(O.timeline(O.translate(runtime_events(spark, sf)), {"hot": 800, "retrieved": 800}))


@query("a25_churn_sweep")
def a25_sweep(spark, sf):
    """The same log under several caps."""
    ops, out = O.translate(runtime_events(spark, sf)), None
    for cap in (400, 800, 1600):
        part = O.churn(O.timeline(ops, {"hot": cap, "retrieved": cap})).agg(F.lit(cap).alias("cap"), F.sum("evictions").alias("evictions"), F.sum("readds").alias("readds"))
        out = part if out is None else out.union(part)
    return out


@query("j3_manifest_diff", f"WITH {RT} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM (SELECT DISTINCT id FROM rt WHERE session_id = 1 AND kind = 'click') a FULL JOIN (SELECT DISTINCT id FROM rt WHERE session_id = 2 AND kind = 'click') b ON a.id = b.id")
def j3(spark, sf):
    ids = lambda s: runtime_events(spark, sf).where(f"session_id = {s}").select(F.explode("items_added").alias("i")).where("i.bucket = 'hot'").select("i.id").distinct()
    return O.diff(ids(1), ids(2))


ITEMS = """
it AS (SELECT session_id, id, max(tokens) AS tokens, max(ord) % 7 AS touched, bool_or(pinned) AS pinned, sum(tokens) % 13 AS score FROM rt WHERE kind = 'click' GROUP BY 1, 2)"""


def items(spark, sf):
    e = runtime_events(spark, sf).select("session_id", "ord", F.explode("items_added").alias("i")).where("i.bucket = 'hot'")
    return e.groupBy("session_id", F.col("i.id").alias("id")).agg(F.max("i.tokens").alias("tokens"), (F.max("ord") % 7).alias("touched"), F.bool_or("i.pinned").alias("pinned"), (F.sum("i.tokens") % 13).alias("score"))


for _policy, _order in (("lru", ["touched", "id"]), ("pinned_first", ["touched", "id"]), ("recency_weighted", ["score", "touched", "id"])):

    @query(f"w16_evict_{_policy}", f"WITH {RT}, {ITEMS} SELECT session_id, id FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY {', '.join(_order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM it WHERE NOT pinned) WHERE freed < 500")
    def _w16(spark, sf, order=_order):
        return O.evictions(items(spark, sf).withColumn("need", F.lit(500)), "need", order, ["session_id"]).select("session_id", "id")


@query("w12_latest_session", f"WITH {RT} SELECT session_id, ord FROM rt JOIN (SELECT session_id, max(ord) FILTER (event = 'SessionStart') AS start FROM rt GROUP BY 1) USING (session_id) WHERE ord >= coalesce(start, 0)")
def w12(spark, sf):
    return O.latest_session(runtime_events(spark, sf)).select("session_id", "ord")


@query("w13_since_prompt", f"WITH {RT}, p AS (SELECT session_id, ord AS since FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS k FROM rt WHERE event = 'UserPromptSubmit') WHERE k = 2) SELECT session_id, ord FROM rt LEFT JOIN p USING (session_id) WHERE ord >= coalesce(since, 0)")
def w13(spark, sf):
    return O.since_last_prompt(runtime_events(spark, sf)).select("session_id", "ord")


@query("w15_greedy_chunks", """WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) // 4 + 1 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
g AS (SELECT conv_id, turn, k, t AS used, 0 AS chunk FROM m WHERE k = 1 UNION ALL SELECT m.conv_id, m.turn, m.k, CASE WHEN g.used + m.t > 150 THEN m.t ELSE g.used + m.t END, g.chunk + CASE WHEN g.used + m.t > 150 THEN 1 ELSE 0 END FROM g JOIN m ON m.conv_id = g.conv_id AND m.k = g.k + 1)
SELECT conv_id AS session_id, turn AS ord, CAST(chunk AS BIGINT) AS chunk FROM g""")
def w15(spark, sf):
    c = views.table(spark, sf, "conversations")
    return O.chunks(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), (F.floor(F.length("text") / 4) + 1).cast("long").alias("tokens")), 150)


@query("w17_prompt_dedupe", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY conv_id DESC, turn DESC) AS k FROM conversations WHERE role = 'user' AND length(text) >= 30) WHERE k = 1 ORDER BY conv_id DESC, turn DESC LIMIT 40")
def w17(spark, sf):
    c = views.table(spark, sf, "conversations").where("role = 'user'").where(F.length("text") >= 30)
    newest = c.groupBy(F.substring("text", 1, 200).alias("head")).agg(F.max(F.struct("conv_id", "turn")).alias("m")).select("m.conv_id", "m.turn")
    return newest.orderBy(F.desc("conv_id"), F.desc("turn")).limit(40)


@query("st9_hook_items", f"WITH {RT} SELECT session_id, ord, 'c-' || substr(sha256(id), 1, 16) AS id, tokens FROM rt WHERE kind IN ('click', 'purchase')")
def st9(spark, sf):
    from ..functions.ids import content_id

    return runtime_events(spark, sf).select("session_id", "ord", F.explode("items_added").alias("i")).select("session_id", "ord", content_id(F.col("i.id")).alias("id"), "i.tokens")


@query("sk11_deterministic_dump", f"""WITH {RT} SELECT ord, '{{"event":"' || event || '","ord":' || CAST(ord AS VARCHAR) || ',"session_id":' || CAST(session_id AS VARCHAR) || '}}' AS json FROM rt""")
def sk11(spark, sf):
    return runtime_events(spark, sf).select("ord", F.to_json(F.struct("event", "ord", "session_id")).alias("json"))
