"""Queries that run streams to their end and return what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import claims as C
from ..operators.runtime import translate
from ..sources import jsonl, lines, transcripts
from ..storage import BLOCK, shared_folder
from ..streaming import replay, tail
from .claims import with_claims
from .ingest import records, timed
from .registry import ORACLES, query
from .runtime import runtime_events

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def copied(spark, table, parts, *keys):
    """The table as a folder of files, as a growing log would be; rows of equal keys lie in one file. A task reads row groups whole, so these are small."""
    path = f"{shared_folder(spark)}/in"
    table.repartition(parts, *keys).write.option("parquet.block.size", BLOCK).parquet(path)
    return path


@query("sc13_incremental_tail", "SELECT event_id, event_type FROM events")
def sc13(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", "event_type")
    source, base = copied(spark, e, 4), shared_folder(spark)
    tail.drain(tail.files(spark, source, "event_id BIGINT, event_type STRING", per_batch=2), f"{base}/checkpoint", tail.append_new(f"{base}/out", "event_id"))
    e.limit(10).write.mode("append").parquet(source)  # rows that come again add nothing
    tail.drain(tail.files(spark, source, "event_id BIGINT, event_type STRING", per_batch=2), f"{base}/checkpoint", tail.append_new(f"{base}/out", "event_id"))
    return spark.read.parquet(f"{base}/out")


@query("sc13_byte_tail", "SELECT event_id, event_type FROM events")
def sc13_bytes(spark, sf):
    """The events as a log of JSON lines that grows twice. A batch reads the bytes that came since; a line's file and first byte are its key, so a batch that comes twice adds nothing."""
    e = views.table(spark, sf, "events").select("event_id", "event_type")
    source, base = f"{shared_folder(spark)}/log", shared_folder(spark)
    keyed = F.concat_ws(":", "file", F.col("offset").cast("string")).alias("at")
    for part in (0, 1):
        jsonl.append(e.where(F.col("event_id") % 2 == part), source)
        tail.drain(lines.stream(spark, source, pattern="*.json").select(keyed, "line"), f"{base}/checkpoint", tail.append_new(f"{base}/out", "at"))
    return jsonl.read(spark.read.parquet(f"{base}/out"), "event_id long, event_type string")


@query("j2_pair_stream", ORACLES["j2_tool_pairs"] + """
UNION ALL SELECT conv_id, 't' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'unanswered' FROM conversations a WHERE role = 'assistant' AND turn % 4 <> 3 AND conv_id % 5 <> 0
  AND NOT EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user')""")
def j2_stream(spark, sf):
    """Calls and results arrive as a stream and are paired within ten minutes; calls that nobody answers come out once the watermark has passed them."""
    r = timed(records(spark, sf)).where("session_id % 5 <> 0").withColumn("record", F.col("record").withField("sessionId", F.col("session_id").cast("string")))
    source, base = copied(spark, r, 4), shared_folder(spark)
    # What the log holds last moves the watermark past all that came before.
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.schema)
    when = F.to_timestamp("record.timestamp")

    def keep(batch, number):
        batch.write.mode("append").parquet(f"{base}/out")

    late = r.limit(1).withColumn("session_id", F.lit(-1).cast("long")).withColumn("record", F.col("record").withField("timestamp", F.lit("9999-01-01T00:00:00Z")))
    late.write.mode("append").parquet(source)
    tail.drain(transcripts.paired(tail.files(spark, source, schema, per_batch=100), when, "10 minutes"), f"{base}/checkpoint", keep)
    return spark.read.parquet(f"{base}/out").where("session_id >= 0").select("session_id", "id", "result")


def transcript_files(spark, rows):
    """Conversations' records as transcript files of JSON lines, a session whole in one file and in order, with blank and broken lines between."""
    path = f"{shared_folder(spark)}/transcripts"
    line = F.explode(F.when(F.col("ord") % 3 == 0, F.array(F.to_json("record"), F.lit(" "), F.lit('{"type": "us'))).otherwise(F.array(F.to_json("record"))))
    rows.repartition("session_id").sortWithinPartitions("session_id", "ord").select(line.alias("value")).write.text(path)
    return path


@query("sc11_session_files", ORACLES["sc11_sessions"])
def sc11_files(spark, sf):
    """``sc11_sessions`` over files: read in ranges of bytes, parsed, and ordered by places in the files."""
    found = transcripts.sessions(transcripts.from_lines(lines.read(spark, transcript_files(spark, records(spark, sf)), pattern="*.txt")))
    return found.select(F.col("session_id").cast("long").alias("session_id"), "cwd", "model", "messages", "tokens", "started_at", "ended_at")


@query("j2_pair_files", ORACLES["j2_tool_pairs"])
def j2_files(spark, sf):
    """``j2_tool_pairs`` over files that a stream tails by their bytes; answered calls alone."""
    base, source = shared_folder(spark), transcript_files(spark, timed(records(spark, sf)))
    pairs = transcripts.paired(transcripts.from_lines(lines.stream(spark, source, pattern="*.txt")), F.to_timestamp("record.timestamp"), "10 minutes")
    tail.drain(pairs, f"{base}/checkpoint", tail.append_once(f"{base}/out"))
    found = spark.read.parquet(f"{base}/out").where("result <> 'unanswered'")
    return found.select(F.col("session_id").cast("long").alias("session_id"), "id", "result").where("session_id % 5 <> 0")


def repeated_log(spark, sf):
    """A folder of the events, which come in three parts: the first half, all of them, and the second half again."""
    e = views.table(spark, sf, "events")
    source = f"{shared_folder(spark)}/in"
    for part in ("event_id % 2 = 0", "true", "event_id % 2 = 1"):
        e.where(part).write.mode("append").parquet(source)
        yield source


@query("j12_seen_stream", "SELECT event_id, event_type FROM events")
def j12_stream(spark, sf):
    """Events that were seen in any batch before are dropped by the state of the stream; what was written is never read again."""
    base = shared_folder(spark)
    for source in repeated_log(spark, sf):
        tail.drain(tail.deduplicated(tail.files(spark, source, EVENTS), "event_id"), f"{base}/checkpoint", tail.append_once(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type")


@query("j12_seen_within", "SELECT event_id, event_type FROM events")
def j12_within(spark, sf):
    """As ``j12_seen_stream``, with keys kept for forty days of event time, which is longer than the events' span."""
    base = shared_folder(spark)
    for source in repeated_log(spark, sf):
        rows = tail.files(spark, source, EVENTS).withColumn("at", F.col("ts").cast("timestamp"))
        tail.drain(tail.deduplicated(rows, "event_id", "at", "40 days"), f"{base}/checkpoint", tail.append_once(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type")


@query("st8_claim_stream", views.with_views("ob", "SELECT sha256(topic_key || chr(0) || claim_subject || chr(0) || event_id) AS claim_id FROM ob WHERE kind <> 'tombstone-deleted'"))
def st8_stream(spark, sf):
    """Observations arrive as files; each batch's claims are appended to the log, once."""
    o = views.observations(spark, sf)
    source, base = copied(spark, o, 3, "event_id"), shared_folder(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema)
    stream = C.extract(tail.files(spark, source, schema, per_batch=1))
    tail.drain(stream, f"{base}/checkpoint", tail.append_new(f"{base}/log", "claim_id"))
    return spark.read.parquet(f"{base}/log").select("claim_id")


@query("st8_consolidation_stream", with_claims("SELECT claim_id, stance, CASE WHEN stance = 'superseded' THEN winner END AS superseded_by FROM st"))
def st8_consolidation_stream(spark, sf):
    """Three periods arrive one after the other, and each batch is a consolidation run; the state is that of the batch."""
    from ..operators.consolidate import Memory, batches

    o = views.observations(spark, sf).withColumn("schema_version", F.lit(1))
    base = shared_folder(spark)
    source, schema = f"{base}/in", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema)
    for low, high in ((0, 800_000_000), (800_000_000, 900_000_000), (900_000_000, 10**11)):
        o.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(source)
        tail.drain(tail.files(spark, source, schema), f"{base}/checkpoint", batches(f"{base}/memory"))
    rows = Memory(spark, f"{base}/memory").claims.rows()
    return C.elected(rows).select("claim_id", "stance", "superseded_by")


@query("st1_engine_stream")
def st1_stream(spark, sf):
    """The engine over a stream; its last state is that of the batch replay. Each session's operations come in one file, many sessions in each."""
    ops = translate(runtime_events(spark, sf))
    source, base = copied(spark, ops, 8, "session_id"), shared_folder(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ops.schema)

    def keep(batch, number):
        batch.write.mode("append").parquet(f"{base}/out")

    tail.drain(replay.steps(tail.files(spark, source, schema)), f"{base}/checkpoint", keep)
    return spark.read.parquet(f"{base}/out")


@query("st_window_counts", "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_windows(spark, sf):
    return tail.windowed_counts(views.table(spark, sf, "events"), "ts", "6 hours", "1 hour", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st_session_counts", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def st_sessions(spark, sf):
    return tail.session_counts(views.table(spark, sf, "events"), "ts", "30 minutes", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))
