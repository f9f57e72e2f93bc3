"""Queries of the report family."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import report as R
from ..operators import report as O
from ..operators.ordered import row_numbers
from ..session import AS_OF, moment
from .registry import query

SLUG = r"CASE WHEN trim(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_') = '' THEN '{1}' ELSE substr(trim(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_'), 1, 80) END"
HARNESS = f"""CASE WHEN {SLUG.format('harness', 'unknown')} LIKE '%claude%' THEN 'claude-code' WHEN {SLUG.format('harness', 'unknown')} LIKE '%openclaw%' THEN 'openclaw'
  WHEN {SLUG.format('harness', 'unknown')} LIKE '%hermes%' THEN 'hermes' WHEN {SLUG.format('harness', 'unknown')} LIKE '%codex%' THEN 'codex' WHEN {SLUG.format('harness', 'unknown')} LIKE '%cursor%' THEN 'cursor'
  WHEN {SLUG.format('harness', 'unknown')} LIKE '%opencode%' THEN 'opencode' WHEN {SLUG.format('harness', 'unknown')} LIKE '%windsurf%' THEN 'windsurf'
  WHEN {SLUG.format('harness', 'unknown')} IN ('pi', 'pi_coding_agent') THEN 'pi' ELSE {SLUG.format('harness', 'unknown')} END"""
PHASE = """CASE WHEN regexp_matches(lower(action || ' ' || skill), 'plan|design|spec') THEN 'plan' WHEN regexp_matches(lower(action || ' ' || skill), 'review|audit|security') THEN 'review'
  WHEN regexp_matches(lower(action || ' ' || skill), 'test|qa|verify|benchmark') THEN 'qa' WHEN regexp_matches(lower(action || ' ' || skill), 'ship|deploy|release') THEN 'ship'
  WHEN regexp_matches(lower(action || ' ' || skill), 'debug|investigate|failure') THEN 'debug' WHEN regexp_matches(lower(action || ' ' || skill), 'reflect|memory|learn|dream') THEN 'memory' ELSE 'analysis' END"""
ISO = "regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ'), '\\.000000Z$', 'Z')"
RECORDS = f"""
rec AS (
  SELECT ts AS moment, {HARNESS} AS harness, CASE WHEN ({PHASE}) <> 'analysis' THEN ({PHASE}) ELSE {SLUG.format('skill', 'analysis')} END AS workflow, 'agent' AS run_type, result,
    CASE WHEN result = 'failure' THEN 'error' ELSE result END AS status, duration_ms, nullif(tokens_in + tokens_out, 0) AS tokens_total, tokens_in, tokens_out, cost,
    CASE WHEN agent_id IS NOT NULL THEN substr(sha256(agent_id), 1, 16) END AS agent, importance FROM ep
  UNION ALL
  SELECT started_at, 'cron', 'scheduled_workflow', 'cron', NULL, status, duration_ms, nullif(tokens_in + tokens_out, 0), tokens_in, tokens_out, NULL,
    CASE WHEN agent_id IS NOT NULL THEN substr(sha256(agent_id), 1, 16) END, NULL FROM cr
)"""
OK = "(status = 'success' OR coalesce(result = 'success', false))"
BAD = f"(NOT {OK} AND (status = 'error' OR coalesce(result = 'failure', false)))"
COUNTS = "count(*) FILTER (run_type <> 'cron') AS agent_events, count(*) FILTER (run_type = 'cron') AS cron_runs"
CATEGORY = "CASE WHEN run_type = 'cron' THEN 'automation' WHEN importance >= 6 THEN 'notable' WHEN harness = 'codex' THEN 'coding' ELSE 'uncategorized' END"


def records(spark, sf):
    return O.all_records(views.episodes(spark, sf), views.cron_runs(spark, sf))


def category():
    return F.when(F.col("run_type") == "cron", "automation").when(F.col("importance") >= 6, "notable").when(F.col("harness") == "codex", "coding").otherwise("uncategorized")


def rec(sql: str) -> str:
    return views.with_views("ep cr", f"WITH {RECORDS} {sql}")


for _size in ("hour", "day", "week", "month"):

    @query(f"a1_activity_series_{_size}", rec(f"""
    SELECT strftime(date_trunc('{_size}', moment), '%Y-%m-%dT%H:%M:%SZ') AS bucket_start, {COUNTS}, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
      CAST(sum(coalesce(tokens_total, 0)) AS BIGINT) AS tokens_total, CAST(round(sum(CAST(coalesce(cost, 0) AS DECIMAL(18, 6))), 4) AS DOUBLE) AS cost, count(DISTINCT agent) AS active_agents FROM rec GROUP BY 1"""))
    def _series(spark, sf, size=_size):
        return O.activity_series(records(spark, sf), size)


@query("a2_count_by", rec("SELECT workflow AS key, count(*) AS n FROM rec GROUP BY 1"))
def a2(spark, sf):
    return O.count_by(records(spark, sf), "workflow")


@query("a3_category_summary", rec(f"""SELECT {CATEGORY} AS category, {COUNTS}, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(coalesce(tokens_total, 0)) AS BIGINT) AS tokens_total,
  CAST(round(sum(CAST(coalesce(cost, 0) AS DECIMAL(18, 6))), 4) AS DOUBLE) AS cost, round_even(sum(duration_ms) / 3600000, 2) AS hours FROM rec GROUP BY 1"""))
def a3(spark, sf):
    return O.category_summary(records(spark, sf), category())


@query("a4_harness_summary", rec(f"""SELECT harness, {COUNTS}, count(*) FILTER ({OK}) AS successes, count(*) FILTER ({BAD}) AS errors, CAST(sum(coalesce(tokens_total, 0)) AS BIGINT) AS tokens_total,
  CAST(round(sum(CAST(coalesce(cost, 0) AS DECIMAL(18, 6))), 4) AS DOUBLE) AS cost, count(DISTINCT agent) AS active_agents FROM rec GROUP BY 1"""))
def a4(spark, sf):
    return O.harness_summary(records(spark, sf))


@query("a5_workflow_summary", rec(f"""SELECT workflow, {COUNTS}, count(*) FILTER ({OK}) AS successes, count(*) FILTER ({BAD}) AS errors, CAST(sum(coalesce(tokens_total, 0)) AS BIGINT) AS tokens_total,
  round_even(count(*) FILTER ({OK}) / count(*), 3) AS success_rate FROM rec GROUP BY 1"""))
def a5(spark, sf):
    return O.workflow_summary(records(spark, sf))


@query("a6_kpi_summary", rec(f""", k AS (SELECT {COUNTS}, count(*) AS n, count(DISTINCT agent) AS active_agents, count(DISTINCT harness) AS harnesses, count(DISTINCT workflow) AS workflows, count(DISTINCT {CATEGORY}) AS categories,
  count(*) FILTER ({OK}) AS ok, count(*) FILTER ({BAD}) AS bad, median(duration_ms) AS med, sum(coalesce(tokens_total, 0)) AS tok, CAST(sum(CAST(coalesce(cost, 0) AS DECIMAL(18, 6))) AS DOUBLE) AS cost, greatest(1, count(DISTINCT CAST(moment AS DATE))) AS days FROM rec)
SELECT unnest(['agent_events', 'cron_runs', 'cron_runs_per_day', 'events_per_day', 'active_agents', 'harnesses', 'workflows', 'categories', 'successes', 'errors', 'success_rate', 'error_rate', 'median_duration_ms',
    'tokens_total_estimate', 'tokens_per_run_estimate', 'cost_estimate_usd', 'cost_per_run_estimate_usd']) AS kpi,
  unnest([CAST(agent_events AS DOUBLE), cron_runs, round_even(cron_runs / days, 3), round_even(agent_events / days, 3), active_agents, harnesses, workflows, categories, ok, bad, round_even(ok / n, 3), round_even(bad / n, 3), med,
    CAST(tok AS DOUBLE), round_even(CAST(tok AS DOUBLE) / n, 3), round(cost, 4), round(cost / n, 4)]) AS value FROM k"""))
def a6(spark, sf):
    return O.kpis(records(spark, sf), category())


@query("a7_median_sum_days", rec("SELECT run_type, median(duration_ms) AS median_ms, CAST(sum(coalesce(tokens_total, 0)) AS BIGINT) AS tokens, greatest(1, count(DISTINCT CAST(moment AS DATE))) AS observed_days FROM rec GROUP BY 1"))
def a7(spark, sf):
    return records(spark, sf).groupBy("run_type").agg(F.median("duration_ms").alias("median_ms"), F.sum(F.coalesce("tokens_total", F.lit(0))).alias("tokens"), F.greatest(F.lit(1).cast("long"), F.countDistinct(F.to_date("at"))).alias("observed_days"))


RECALL = """
rc AS (SELECT ord, CASE action WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'skip' ELSE 'hit' END AS outcome, CASE WHEN action = 'view' AND user_id % 4 <> 0 THEN ['too_short', 'slash', 'ack'][CAST(user_id % 3 + 1 AS INT)] END AS skip_reason,
  tokens_in AS latency_ms, tokens_out % 6 AS k_returned, [duration_ms % 100 / 100.0, tokens_out / 100.0] AS scores, ['notes', 'digests'] AS sk, [tokens_out % 3, tokens_out % 2] AS sv FROM ep)"""


def recall_events(spark, sf):
    e = views.episodes(spark, sf)
    reason = F.element_at(F.array(F.lit("too_short"), F.lit("slash"), F.lit("ack")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        "ord", F.when(F.col("action") == "error", "timeout").when(F.col("action") == "view", "skip").otherwise("hit").alias("outcome"), F.when((F.col("action") == "view") & (F.col("user_id") % 4 != 0), reason).alias("skip_reason"),
        F.col("tokens_in").alias("latency_ms"), (F.col("tokens_out") % 6).alias("k_returned"), F.array(F.col("duration_ms") % 100 / 100.0, F.col("tokens_out") / 100.0).alias("scores"),
        F.create_map(F.lit("notes"), F.col("tokens_out") % 3, F.lit("digests"), F.col("tokens_out") % 2).alias("sources"),
    )


BUCKET = "CASE WHEN s >= 0.85 THEN '0.85+' WHEN s >= 0.70 THEN '0.70-0.85' WHEN s >= 0.50 THEN '0.50-0.70' ELSE '<0.50' END"


@query("a8_recall_report", views.with_views("ep", f"""WITH {RECALL}
SELECT 'outcome' AS section, CASE WHEN outcome IN ('hit', 'skip') THEN outcome ELSE 'other' END AS key, count(*) AS value FROM rc GROUP BY 1, 2
UNION ALL SELECT 'skip_reason', coalesce(skip_reason, 'unknown'), count(*) FROM rc WHERE outcome = 'skip' GROUP BY 2
UNION ALL SELECT 'surfaced', 'docs', CAST(sum(k_returned) AS BIGINT) FROM rc WHERE outcome = 'hit'
UNION ALL SELECT 'source', k, CAST(sum(v) AS BIGINT) FROM (SELECT unnest(sk) AS k, unnest(sv) AS v FROM rc WHERE outcome = 'hit') GROUP BY 2
UNION ALL SELECT 'score', {BUCKET}, count(*) FROM (SELECT unnest(scores) AS s FROM rc WHERE outcome = 'hit') GROUP BY 2
UNION ALL SELECT 'latency', 'p50', CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) FROM rc WHERE outcome = 'hit'
UNION ALL SELECT 'latency', 'p95', CAST(floor(quantile_cont(latency_ms, 0.95)) AS BIGINT) FROM rc WHERE outcome = 'hit'"""))
def a8(spark, sf):
    return O.recall_report(recall_events(spark, sf))


@query("a9_percentiles", views.with_views("ep", "SELECT skill, CAST(floor(quantile_cont(tokens_in, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(tokens_in, 0.95)) AS BIGINT) AS p95 FROM ep GROUP BY 1"))
def a9(spark, sf):
    return views.episodes(spark, sf).groupBy("skill").agg(*[F.floor(F.percentile("tokens_in", F.lit(p / 100))).cast("long").alias(f"p{p}") for p in (50, 95)])


@query("a10_score_buckets", views.with_views("ep", f"SELECT {BUCKET} AS bucket, count(*) AS n FROM (SELECT tokens_out / 100.0 AS s FROM ep) GROUP BY 1"))
def a10(spark, sf):
    return views.episodes(spark, sf).groupBy(R.score_bucket(F.col("tokens_out") / 100.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("a11_tool_calls", views.with_views("ep", """SELECT CASE WHEN tool LIKE 'mcp\\_\\_%\\_\\_%' ESCAPE '\\' THEN regexp_replace(tool, '^(mcp__[^_]+)__.*$', '\\1__*') ELSE tool END AS tool, count(*) AS n
FROM (SELECT CASE action WHEN 'view' THEN 'mcp__search__q' || CAST(user_id % 5 AS VARCHAR) WHEN 'click' THEN 'mcp__files__get' ELSE action END AS tool FROM ep) GROUP BY 1"""))
def a11(spark, sf):
    tool = F.when(F.col("action") == "view", F.concat(F.lit("mcp__search__q"), (F.col("user_id") % 5).cast("string"))).when(F.col("action") == "click", "mcp__files__get").otherwise(F.col("action"))
    named = F.when(tool.startswith("mcp__") & (F.size(F.split(tool, "__")) >= 3), F.regexp_replace(tool, r"^(mcp__.*?)__.*$", "$1__*")).otherwise(tool)
    return views.episodes(spark, sf).groupBy(named.alias("tool")).agg(F.count(F.lit(1)).alias("n"))


@query("a12_namespace_stats", views.with_views("ep", """SELECT coalesce(origin, 'total') AS namespace, count(*) AS episodes, count(*) FILTER (result = 'failure') AS failures, count(*) FILTER (importance >= 9) AS candidates
FROM ep GROUP BY GROUPING SETS ((origin), ())"""))
def a12(spark, sf):
    out = views.episodes(spark, sf).rollup("origin").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("result") == "failure").alias("failures"), F.count_if(F.col("importance") >= 9).alias("candidates"))
    return out.select(F.coalesce("origin", F.lit("total")).alias("namespace"), "episodes", "failures", "candidates")


@query("a17_recent_failures", views.with_views("ep", """SELECT ord, skill, recent, recent >= 3 AS flagged, CAST(CASE WHEN recent >= 3 THEN 10 ELSE pain_score END AS BIGINT) AS pain FROM (
  SELECT *, count(*) OVER (PARTITION BY skill ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 1209600 PRECEDING AND CURRENT ROW) AS recent FROM ep WHERE result = 'failure')"""))
def a17(spark, sf):
    return O.failure_flags(views.episodes(spark, sf))


@query("a28_telemetry_grouping_sets", views.with_views("ep", "SELECT action AS event, coalesce(skill, '*') AS tool, count(*) AS n, count(DISTINCT user_id) AS sessions FROM ep GROUP BY GROUPING SETS ((action), (action, skill))"))
def a28(spark, sf):
    views.episodes(spark, sf).createOrReplaceTempView("__a28")
    return spark.sql("SELECT action AS event, coalesce(skill, '*') AS tool, count(*) AS n, count(DISTINCT user_id) AS sessions FROM __a28 GROUP BY GROUPING SETS ((action), (action, skill))")


@query("j17_deliverability", views.with_views("ep", """SELECT action AS event, want, got, CAST(got AS DOUBLE) / want AS rate FROM (
  SELECT x.action, x.want, count(e.ord) AS got FROM (VALUES ('view', 1500), ('click', 2500), ('missing', 10)) x(action, want) LEFT JOIN ep e ON e.action = x.action GROUP BY 1, 2)""").replace("SELECT action AS event, want,", "SELECT action AS event, CAST(want AS BIGINT) AS want,"))
def j17(spark, sf):
    expected = spark.createDataFrame([("view", 1500), ("click", 2500), ("missing", 10)], "event string, want long")
    seen = views.episodes(spark, sf).groupBy(F.col("action").alias("event")).agg(F.count(F.lit(1)).alias("got"))
    return expected.join(seen, "event", "left").select("event", "want", F.coalesce("got", F.lit(0)).alias("got"), (F.coalesce("got", F.lit(0)) / F.col("want")).alias("rate"))


@query("w10_cron_timeline", views.with_views("cr", """WITH e AS (SELECT *, greatest(started_at, started_at + to_milliseconds(duration_ms)) AS fin FROM cr), s AS (SELECT epoch_ms(min(started_at)) AS a, greatest(1, epoch_ms(max(fin)) - epoch_ms(min(started_at))) AS w FROM e)
SELECT ord, row_number() OVER (ORDER BY started_at, name, ord) - 1 AS lane, name, duration_ms, round(CAST(epoch_ms(started_at) - a AS DOUBLE) / w * 100, 3) AS start_offset_pct,
  round(greatest(CAST(greatest(1, epoch_ms(fin) - epoch_ms(started_at)) AS DOUBLE) / w * 100, 0.8), 3) AS width_pct FROM e, s"""))
def w10(spark, sf):
    return O.cron_timeline(views.cron_runs(spark, sf))


@query("pf3_time_window", views.with_views("ep", f"SELECT win, count(*) AS n FROM ep, (VALUES ('7d', 7), ('30d', 30), ('90d', 90)) x(win, days) WHERE ts >= TIMESTAMP '{AS_OF}' - to_days(days) GROUP BY 1"))
def pf3(spark, sf):
    windows = F.array(*[F.struct(F.lit(f"{d}d").alias("win"), F.lit(d).alias("days")) for d in (7, 30, 90)])
    rows = views.episodes(spark, sf).where(F.col("ts") >= moment() - F.expr("INTERVAL 90 DAYS")).select("ts", F.inline(windows))
    return rows.where(F.col("ts") >= moment() - F.make_dt_interval(F.col("days"))).groupBy("win").agg(F.count(F.lit(1)).alias("n"))


@query("pf16_category_rules", rec(""", rules(ord, dim, val, cat) AS (VALUES (1, 'harness', 'claude-code', 'coding'), (2, 'workflow', 'skill_3', 'research'), (3, 'status', 'error', 'incident'), (4, 'run_type', 'cron', 'scheduled'))
SELECT coalesce(min_by(cat, r.ord), 'uncategorized') AS category, rid % 10 AS slot, rid FROM (SELECT *, row_number() OVER (ORDER BY run_type, moment, harness, workflow, status, duration_ms) AS rid FROM rec) x
LEFT JOIN rules r ON (dim = 'harness' AND harness = val) OR (dim = 'workflow' AND workflow = val) OR (dim = 'status' AND status = val) OR (dim = 'run_type' AND run_type = val) GROUP BY rid"""))
def pf16(spark, sf):
    """Rules are few and fixed, so they compile into one ordered CASE: no join at all."""
    rules = [("harness", "claude-code", "coding"), ("workflow", "skill_3", "research"), ("status", "error", "incident"), ("run_type", "cron", "scheduled")]
    ladder = F.when(F.lit(False), F.lit(""))
    for dim, value, name in rules:
        ladder = ladder.when(F.col(dim) == value, name)
    numbered = row_numbers(records(spark, sf), ["run_type", "at", "harness", "workflow", "status", "duration_ms"], "rid")
    return numbered.select(ladder.otherwise("uncategorized").alias("category"), (F.col("rid") % 10).alias("slot"), "rid")


@query("pf17_harness", views.with_views("ep", f"SELECT DISTINCT harness AS raw, {HARNESS} AS harness FROM ep"))
def pf17(spark, sf):
    return views.episodes(spark, sf).select(F.col("harness").alias("raw"), R.harness(F.col("harness")).alias("harness")).distinct()


@query("pf19_event_normalize", views.with_views("ep", f"""SELECT ord, 'evt_' || substr(sha256({ISO.format('ts')} || '|' || skill || '|' || action || '|' || coalesce(agent_id, 'None') || '|' || CAST(row_number() OVER (ORDER BY ord) - 1 AS VARCHAR)), 1, 16) AS id,
  {ISO.format('ts')} AS started_at, {HARNESS} AS harness, CASE WHEN result = 'failure' THEN 'error' ELSE result END AS status, nullif(tokens_in + tokens_out, 0) AS tokens_total, {PHASE} AS phase FROM ep"""))
def pf19(spark, sf):
    return O.normalize_events(views.episodes(spark, sf)).select("ord", "id", "started_at", "harness", "status", "tokens_total", "phase")


@query("pf20_cron_normalize", views.with_views("cr", f"SELECT ord, 'cron_' || substr(sha256({ISO.format('started_at')} || '|' || name || '|' || CAST(ord AS VARCHAR)), 1, 16) AS id, {ISO.format('started_at')} AS started_at, status, duration_ms, nullif(tokens_in + tokens_out, 0) AS tokens_total FROM cr"))
def pf20(spark, sf):
    return O.normalize_crons(views.cron_runs(spark, sf)).select("ord", "id", "started_at", "status", "duration_ms", "tokens_total")


@query("u1_union_all", rec("SELECT run_type, status, count(*) AS n FROM rec GROUP BY 1, 2"))
def u1(spark, sf):
    return records(spark, sf).groupBy("run_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("f28_time_buckets", views.with_views("cr", "SELECT ord, strftime(date_trunc('week', started_at), '%Y-%m-%dT%H:%M:%SZ') AS week, strftime(date_trunc('month', started_at), '%Y-%m-%dT%H:%M:%SZ') AS month FROM cr"))
def f28(spark, sf):
    return views.cron_runs(spark, sf).select("ord", R.bucket(F.col("started_at"), "week").alias("week"), R.bucket(F.col("started_at"), "month").alias("month"))
