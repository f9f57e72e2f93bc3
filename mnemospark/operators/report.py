"""Activity reports over normalised agent events and cron runs.

Both kinds are one table, so that each report is one aggregation with partial sums.
Counts of distinct agents are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import report as R
from .ordered import row_numbers


def normalize_events(episodes: DataFrame) -> DataFrame:
    """Agent events in the reports' columns."""
    started = R.iso(F.col("ts"))
    if "idx" not in episodes.columns:
        episodes = row_numbers(episodes, ["ord"], "idx").withColumn("idx", F.col("idx") - 1)
    tokens = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    return episodes.select(
        "ord", F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", started, "skill", "action", F.coalesce("agent_id", F.lit("None")), F.col("idx").cast("string")), 256), 1, 16)).alias("id"),
        F.col("ts").alias("at"), started.alias("started_at"), R.harness(F.col("harness")).alias("harness"), "skill", "action",
        R.workflow(F.col("action"), F.col("skill")).alias("workflow"), R.phase(F.col("action"), F.col("skill")).alias("phase"), F.lit("agent").alias("run_type"),
        "result", F.when(F.col("result") == "success", "success").when(F.col("result") == "failure", "error").otherwise(F.coalesce("result", F.lit("unknown"))).alias("status"),
        "duration_ms", F.nullif(tokens, F.lit(0)).alias("tokens_total"), "tokens_in", "tokens_out", "cost", R.hashed_id(F.col("agent_id")).alias("agent"),
        "importance", "pain_score",
    )


def normalize_crons(runs: DataFrame) -> DataFrame:
    """Cron runs in the same columns; a missing duration is that between start and end."""
    tokens = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    return runs.select(
        "ord", F.concat(F.lit("cron_"), F.substring(F.sha2(F.concat_ws("|", R.iso(F.col("started_at")), "name", F.col("ord").cast("string")), 256), 1, 16)).alias("id"),
        F.col("started_at").alias("at"), R.iso(F.col("started_at")).alias("started_at"), F.lit("cron").alias("harness"), F.lit(None).cast("string").alias("skill"), F.lit(None).cast("string").alias("action"),
        F.lit("scheduled_workflow").alias("workflow"), F.lit("automation").alias("phase"), F.lit("cron").alias("run_type"), F.lit(None).cast("string").alias("result"), "status",
        "duration_ms", F.nullif(tokens, F.lit(0)).alias("tokens_total"), "tokens_in", "tokens_out", F.lit(None).cast("double").alias("cost"), R.hashed_id(F.col("agent_id")).alias("agent"),
        F.lit(None).cast("long").alias("importance"), F.lit(None).cast("long").alias("pain_score"),
    )


def all_records(episodes: DataFrame, runs: DataFrame) -> DataFrame:
    """UNION ALL of both kinds. The running index of events plays no part in reports and is left out."""
    return normalize_events(episodes.withColumn("idx", F.lit(0))).unionByName(normalize_crons(runs))


def _n(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False))).cast("long")


def _total(column: str) -> Column:
    return F.sum(F.coalesce(F.col(column), F.lit(0)))


def _dollars() -> Column:
    """Summed as decimals, so that the order of rows plays no part, and rounded to four digits."""
    return F.round(F.sum(F.coalesce(F.col("cost"), F.lit(0.0)).cast("decimal(18,6)")), 4).cast("double")


def _counts() -> list[Column]:
    return [_n(F.col("run_type") != "cron").alias("agent_events"), _n(F.col("run_type") == "cron").alias("cron_runs")]


def succeeded() -> Column:
    return (F.col("status") == "success") | F.coalesce(F.col("result") == "success", F.lit(False))


def failed() -> Column:
    return ~succeeded() & ((F.col("status") == "error") | F.coalesce(F.col("result") == "failure", F.lit(False)))


def activity_series(records: DataFrame, size: str) -> DataFrame:
    """Events, runs, tokens, cost and distinct agents for each time bucket."""
    return records.groupBy(R.bucket(F.col("at"), size).alias("bucket_start")).agg(
        *_counts(), _total("tokens_in").alias("tokens_in"), _total("tokens_out").alias("tokens_out"), _total("tokens_total").alias("tokens_total"),
        _dollars().alias("cost"), F.countDistinct("agent").alias("active_agents"),
    )


def count_by(records: DataFrame, field: str) -> DataFrame:
    """Rows for each value; null and empty are ``unknown``. Most frequent first, then by name."""
    key = F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit("unknown"))
    return records.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def category_summary(records: DataFrame, category: Column) -> DataFrame:
    out = records.groupBy(category.alias("category")).agg(*_counts(), _total("duration_ms").alias("duration_ms"), _total("tokens_total").alias("tokens_total"), _dollars().alias("cost"))
    return out.withColumn("hours", F.bround(F.col("duration_ms") / 3600000, 2))


def harness_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("harness").agg(*_counts(), _n(succeeded()).alias("successes"), _n(failed()).alias("errors"), _total("tokens_total").alias("tokens_total"), _dollars().alias("cost"), F.countDistinct("agent").alias("active_agents"))


def workflow_summary(records: DataFrame) -> DataFrame:
    out = records.groupBy("workflow").agg(*_counts(), _n(succeeded()).alias("successes"), _n(failed()).alias("errors"), _total("tokens_total").alias("tokens_total"))
    return out.withColumn("success_rate", F.bround(F.col("successes") / (F.col("agent_events") + F.col("cron_runs")), 3))


def kpis(records: DataFrame, category: Column) -> DataFrame:
    """One row for each key figure, from a single aggregation."""
    total = F.col("n").cast("double")
    a = records.withColumn("__category", category).agg(
        *_counts(), F.count(F.lit(1)).alias("n"), F.countDistinct("agent").alias("active_agents"), F.countDistinct("harness").alias("harnesses"), F.countDistinct("workflow").alias("workflows"),
        F.countDistinct("__category").alias("categories"), _n(succeeded()).alias("successes"), _n(failed()).alias("errors"), F.median("duration_ms").alias("median_duration_ms"),
        _total("tokens_total").alias("tokens_total"), F.sum(F.coalesce(F.col("cost"), F.lit(0.0)).cast("decimal(18,6)")).cast("double").alias("cost"), F.greatest(F.lit(1), F.countDistinct(F.to_date("at"))).alias("days"),
    )
    rows = {
        "agent_events": F.col("agent_events"), "cron_runs": F.col("cron_runs"), "cron_runs_per_day": F.bround(F.col("cron_runs") / F.col("days"), 3), "events_per_day": F.bround(F.col("agent_events") / F.col("days"), 3),
        "active_agents": F.col("active_agents"), "harnesses": F.col("harnesses"), "workflows": F.col("workflows"), "categories": F.col("categories"), "successes": F.col("successes"), "errors": F.col("errors"),
        "success_rate": F.bround(F.col("successes") / total, 3), "error_rate": F.bround(F.col("errors") / total, 3), "median_duration_ms": F.col("median_duration_ms"), "tokens_total_estimate": F.col("tokens_total"),
        "tokens_per_run_estimate": F.bround(F.col("tokens_total") / total, 3), "cost_estimate_usd": F.round("cost", 4), "cost_per_run_estimate_usd": F.round(F.col("cost") / total, 4),
    }
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), v.cast("double").alias("value")) for k, v in rows.items()])).alias("r")).select("r.kpi", "r.value")


def cron_timeline(runs: DataFrame) -> DataFrame:
    """A lane for each run, by start and name; offset and width in percent of the whole span, widths 0.8 at least.

    """
    end = F.greatest("started_at", F.timestamp_millis(F.unix_millis(F.col("started_at").cast("timestamp")) + F.col("duration_ms")).cast("timestamp_ntz"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    span = runs.agg(F.min("started_at").alias("first"), F.max(end).alias("last"))
    wide = F.greatest(F.lit(1), ms("last") - ms("first"))
    width = F.greatest(F.lit(1), ms("end") - ms("started_at"))
    lane = F.col("lane") - 1
    return row_numbers(runs, ["started_at", "name", "ord"], "lane").withColumn("end", end).crossJoin(F.broadcast(span)).select(
        "ord", lane.cast("long").alias("lane"), "name", "duration_ms", F.round((ms("started_at") - ms("first")) / wide * 100, 3).alias("start_offset_pct"),
        F.round(F.greatest(width / wide * 100, F.lit(0.8)), 3).alias("width_pct"),
    )


def recall_report(events: DataFrame) -> DataFrame:
    """Figures of recall telemetry as rows (section, key, value): outcomes, skip reasons, sources, score buckets, latencies.

    Latency percentiles are interpolated and cut to whole milliseconds.
    """
    hits = events.where("outcome = 'hit'")

    def rows(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
        return df.groupBy(key.alias("key")).agg(value.cast("long").alias("value")).select(F.lit(section).alias("section"), "key", "value")

    one = F.count(F.lit(1))
    latency = hits.agg(F.array(*[F.struct(F.lit(f"p{p}").alias("key"), F.coalesce(F.floor(F.percentile("latency_ms", F.lit(p / 100))), F.lit(0)).cast("long").alias("value")) for p in (50, 95)]).alias("r"))
    parts = [
        rows(events, "outcome", F.when(F.col("outcome").isin("hit", "skip"), F.col("outcome")).otherwise("other"), one),
        rows(events.where("outcome = 'skip'"), "skip_reason", F.coalesce("skip_reason", F.lit("unknown")), one),
        rows(hits, "surfaced", F.lit("docs"), F.sum("k_returned")),
        rows(hits.select(F.explode("sources").alias("k", "v")), "source", F.col("k"), F.sum("v")),
        rows(hits.select(F.explode("scores").alias("s")), "score", R.score_bucket(F.col("s")), one),
        latency.select(F.explode("r").alias("r")).select(F.lit("latency").alias("section"), "r.key", "r.value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failure_flags(episodes: DataFrame, days: int = 14, threshold: int = 3) -> DataFrame:
    """Failures of a skill in the window up to each of its failures, and whether it is to be flagged.

    Whole days are summed by day, and seconds count only within the first and the last day, so that a task holds a day of a skill, not all of a hot one.
    """
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    day, second = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    failed = episodes.where("result = 'failure'").select("ord", "skill", "pain_score", day.alias("day"), second.alias("second"))
    # Each failure stands in its own day, and asks the first day of its window what came before its time of day.
    both = failed.withColumn("own", F.lit(True)).union(failed.select("ord", "skill", "pain_score", F.col("day") - days, "second", F.lit(False)))
    upto = Window.partitionBy("skill", "day").orderBy("second").rangeBetween(Window.unboundedPreceding, 0)
    less = Window.partitionBy("skill", "day").orderBy("second").rangeBetween(Window.unboundedPreceding, -1)
    own = F.count_if(F.col("own"))
    within = both.select("ord", "skill", "pain_score", F.when(F.col("own"), F.col("day")).otherwise(F.col("day") + days).alias("day"), F.when(F.col("own"), own.over(upto)).otherwise(-own.over(less)).alias("n"))
    edges = within.groupBy("ord", "skill", "pain_score", "day").agg(F.sum("n").alias("edges"))
    by_day = Window.partitionBy("skill").orderBy("day").rangeBetween(-days, -1)
    daily = failed.groupBy("skill", "day").agg(F.count(F.lit(1)).alias("n")).select("skill", "day", F.coalesce(F.sum("n").over(by_day), F.lit(0)).alias("before"))
    out = edges.join(daily, ["skill", "day"]).withColumn("recent", F.col("edges") + F.col("before"))
    return out.select("ord", "skill", "recent", (F.col("recent") >= threshold).alias("flagged"), F.when(F.col("recent") >= threshold, 10).otherwise(F.col("pain_score")).cast("long").alias("pain"))
