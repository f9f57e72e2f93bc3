"""Inputs of the operators, built from the driver's tables: episodes, cron runs, claims and so on.

They stand in for agent data: deterministic, and ordered by ``ord`` where order matters.
Each has its SQL twin in ``SQL``, to be put before an oracle query by ``with_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that one task reads.
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of less than one split, which one task would read, dealt to all cores: worth it for work on texts."""
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SPLIT
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


HARNESSES = ["Claude Code", "open-claw", "hermes-2", "codex_cli", "Cursor", "opencode", "windsurf", "pi"]
ORIGINS = ["coding.tool_call", "team.inbox", "session.digest"]


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodic events, one for each row of ``events``."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    failed = kind == "error"
    importance = F.when(kind == "purchase", 9).when(kind == "signup", 6).when(failed, 5).otherwise(3).cast("long")
    pain = F.when(failed, F.when(importance < 9, 8).otherwise(10)).when(importance >= 8, 5).when(importance >= 6, 3).otherwise(2).cast("long")
    return e.select(
        F.col("event_id").alias("ord"), "ts", "user_id",
        F.concat(F.lit("skill_"), (F.col("user_id") % 10).cast("string")).alias("skill"),
        kind.alias("action"), F.when(failed, "failure").otherwise("success").alias("result"),
        importance.alias("importance"), pain.alias("pain_score"),
        F.element_at(F.array(*map(F.lit, ORIGINS)), (F.col("user_id") % 3 + 1).cast("int")).alias("origin"),
        F.element_at(F.array(*map(F.lit, HARNESSES)), (F.col("user_id") % 8 + 1).cast("int")).alias("harness"),
        F.floor("value").cast("long").alias("tokens_in"), F.get_json_object("props", "$.k").cast("long").alias("tokens_out"),
        F.floor(F.col("value") * 100).cast("long").alias("duration_ms"), F.round(F.col("value") / 1000, 6).alias("cost"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("agent-"), F.col("user_id").cast("string"))).alias("agent_id"),
    )


def cron_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled runs, one for each order."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("started_at"),
        F.floor("o_totalprice").cast("long").alias("duration_ms"),
        F.when(status == "F", "success").when(status == "O", "error").otherwise("unknown").alias("status"),
        F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("cron-"), (F.col("o_custkey") % 40).cast("string"))).alias("agent_id"),
        (F.col("o_custkey") % 100).cast("long").alias("tokens_in"), (F.col("o_orderkey") % 50).cast("long").alias("tokens_out"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim-bearing events, one for each order; some delete the same customer's order before."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    deletes = F.col("o_orderkey") % 97 == 0
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("event_id"),
        F.when(deletes, "tombstone-deleted").otherwise("observation").alias("kind"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("topic_key"), F.lit("order-status").alias("claim_subject"),
        F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("source_ts"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("ts"),
        F.when(deletes, F.lpad(before.cast("string"), 10, "0")).alias("supersedes_event_id"),
    )


def memory_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory documents: path, source, type, body, and a review flag from the labels."""
    d, q = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(q, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), "source", F.col("text").alias("body"),
        F.col("lang").alias("type"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("needs_review"),
    )


def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and body of ``memory_docs``. Labels only decide how often a document comes, which is once unless their ids repeat, so texts are not joined with them."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null")
    if not labels.isEmpty():
        return memory_docs(spark, sf_dir).select("doc_id", "path", "body")
    path = F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", path, F.col("text").alias("body"))


SQL = {
    "ep": """
ep0 AS (
  SELECT event_id AS ord, ts, user_id, 'skill_' || CAST(user_id % 10 AS VARCHAR) AS skill, event_type AS action,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result,
    CAST(CASE event_type WHEN 'purchase' THEN 9 WHEN 'signup' THEN 6 WHEN 'error' THEN 5 ELSE 3 END AS BIGINT) AS importance,
    ['coding.tool_call', 'team.inbox', 'session.digest'][CAST(user_id % 3 + 1 AS INT)] AS origin,
    ['Claude Code', 'open-claw', 'hermes-2', 'codex_cli', 'Cursor', 'opencode', 'windsurf', 'pi'][CAST(user_id % 8 + 1 AS INT)] AS harness,
    CAST(floor(value) AS BIGINT) AS tokens_in, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out,
    CAST(floor(value * 100) AS BIGINT) AS duration_ms, round(value / 1000, 6) AS cost,
    CASE WHEN user_id % 7 <> 0 THEN 'agent-' || CAST(user_id AS VARCHAR) END AS agent_id
  FROM events
), ep AS (
  SELECT *, CAST(CASE WHEN result = 'failure' THEN CASE WHEN importance < 9 THEN 8 ELSE 10 END
    WHEN importance >= 8 THEN 5 WHEN importance >= 6 THEN 3 ELSE 2 END AS BIGINT) AS pain_score FROM ep0
)""",
    "cr": """
cr AS (
  SELECT o_orderkey AS ord, o_orderpriority AS name, o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' ELSE 'unknown' END AS status,
    CASE WHEN o_custkey % 5 <> 0 THEN 'cron-' || CAST(o_custkey % 40 AS VARCHAR) END AS agent_id,
    CAST(o_custkey % 100 AS BIGINT) AS tokens_in, CAST(o_orderkey % 50 AS BIGINT) AS tokens_out
  FROM orders
)""",
    "ob": """
ob AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS event_id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'tombstone-deleted' ELSE 'observation' END AS kind,
    'customer:' || CAST(o_custkey AS VARCHAR) AS topic_key, 'order-status' AS claim_subject, o_orderstatus AS value, o_orderdate AS source_ts,
    CAST(epoch(o_orderdate) AS DOUBLE) AS ts,
    CASE WHEN o_orderkey % 97 = 0 THEN lpad(CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 10, '0') END AS supersedes_event_id
  FROM orders
)""",
    "md": """
md AS (
  SELECT d.doc_id, 'doc/' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS path, source, text AS body, lang AS type, coalesce(quality = 0, false) AS needs_review
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)""",
}


def with_views(names: str, sql: str) -> str:
    """An oracle query that may use the named views (``ep cr ob md``)."""
    views = ",".join(SQL[n] for n in names.split())
    rest = sql.strip()
    if rest[:5].upper() == "WITH ":
        return f"WITH {views}, {rest[5:]}"
    return f"WITH {views} {rest}"
