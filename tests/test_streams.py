"""Streams of pairs and of seen keys, batch after batch."""

import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mnemospark.plans import streaming
from mnemospark.sources import lines, transcripts
from mnemospark.storage import shared_folder
from mnemospark.streaming import tail

RECORD = "session_id long, ord long, record struct<type:string,timestamp:string,message:struct<role:string,model:string,content:string>>"


def call(session, ord, minute, id, name="Bash"):
    return (session, ord, ("assistant", f"2024-01-01T00:{minute:02d}:00Z", ("assistant", "m", json.dumps([{"type": "tool_use", "id": id, "name": name}]))))


def result(session, ord, minute, id, failed=False):
    return (session, ord, ("user", f"2024-01-01T00:{minute:02d}:00Z", ("user", None, json.dumps([{"type": "tool_result", "tool_use_id": id, "is_error": failed}]))))


def said(session, ord, minute):
    return (session, ord, ("user", f"2024-01-01T00:{minute:02d}:00Z", ("user", None, "text")))


def test_pairs_come_when_answered_or_when_too_late(spark):
    base = shared_folder(spark)
    got = []

    def run(*rows):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(f"{base}/in")
        got.clear()
        stream = transcripts.paired(tail.files(spark, f"{base}/in", RECORD), F.to_timestamp("record.timestamp"), "10 minutes")
        tail.drain(stream, f"{base}/checkpoint", lambda batch, n: got.extend((r.session_id, r.id, r.result) for r in batch.collect()))
        return sorted(got)

    # a is answered at once, b later, c never; d's result comes before it; e tells nothing; the same id in another session is another call.
    first = run(call(1, 1, 0, "a"), result(1, 2, 1, "a"), call(1, 3, 1, "b"), call(1, 4, 2, "c"), result(1, 5, 2, "d"), call(1, 6, 2, "d"), call(1, 7, 2, "e", "TodoWrite"), call(2, 1, 2, "a"))
    assert first == [(1, "a", "success")]
    # b and its result come again; once is enough.
    assert run(result(1, 8, 3, "b", True), result(1, 9, 4, "b"), call(1, 10, 4, "b")) == [(1, "b", "failure")]
    # A record that neither calls nor answers moves the watermark.
    assert run(said(3, 1, 50)) == [(1, "c", "unanswered"), (1, "d", "unanswered"), (2, "a", "unanswered")]
    assert run(said(3, 2, 59)) == []


def test_seen_keys_are_dropped_without_reading_what_was_written(spark, tmp_path):
    base = shared_folder(spark)
    schema = "k long, at timestamp"

    def run(keys, minute, **how):
        rows = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("at", F.to_timestamp(F.lit(f"2024-01-01 00:{minute:02d}:00")))
        rows.write.mode("append").parquet(f"{base}/in")
        tail.drain(tail.deduplicated(tail.files(spark, f"{base}/in", schema), "k", **how), f"{base}/checkpoint", tail.append_once(f"file://{tmp_path}/out"))
        return sorted((r.k is None, r.k) for r in spark.read.parquet(f"file://{tmp_path}/out").select("k").collect())

    assert run([1, 1, 2, None], 0) == [(False, 1), (False, 2), (True, None)]
    (next((tmp_path / "out").glob("batch=*/part-*"))).write_bytes(b"broken")  # a handler that reads it would fail
    rows = spark.createDataFrame([(2,), (3,), (None,)], "k long").withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:59:00")))
    rows.write.mode("append").parquet(f"{base}/in")
    tail.drain(tail.deduplicated(tail.files(spark, f"{base}/in", schema), "k"), f"{base}/checkpoint", tail.append_once(f"file://{tmp_path}/more"))
    assert [r.k for r in spark.read.parquet(f"file://{tmp_path}/more").collect()] == [3]


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    put = tail.append_once(f"file://{tmp_path}/out")
    rows = spark.range(5)
    put(rows, 0)
    put(rows.where("id > 3"), 1)
    put(rows.where("id > 3"), 1)
    put(rows.limit(0), 2)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1)]


def test_new_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks of ``append_new`` grow in number with the rows of batch and target, not in size; repeated and held keys come once."""
    monkeypatch.setattr(tail, "PART_ROWS", 100)
    put, out = tail.append_new(f"file://{tmp_path}/out", "k"), f"file://{tmp_path}/out"
    rows = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("v"))
    put(rows.union(rows).coalesce(1), 0)
    sizes = [spark.read.parquet(f"file://{p}").count() for p in (tmp_path / "out").glob("part-*")]
    assert sum(sizes) == 1000 and len(sizes) > 15 and max(sizes) < 150
    put(rows.where("k >= 990").union(spark.range(2000, 2003).select(F.col("id").alias("k"), F.lit("y").alias("v"))), 1)
    put(rows.limit(0), 2)
    got = sorted((r.k is None, r.k, r.v) for r in spark.read.parquet(out).where("k is not null").collect())
    assert got == [(False, k, "x") for k in range(1, 1000)] + [(False, k, "y") for k in range(2000, 2003)]


def test_arriving_files_have_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(streaming, "BLOCK", 1 << 16)
    path = streaming.copied(spark, spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")), 1, "k")
    (file,) = Path(path.removeprefix("file:")).glob("part-*")
    assert pq.ParquetFile(file).metadata.num_row_groups > 10


def test_first_digests(spark):
    rows = [(1, f"d{k:02d}") for k in range(30)] * 2 + [(2, "z"), (2, "y")]
    got = transcripts.first_digests(spark.createDataFrame(rows, "session_id long, digest string"), 3)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "d00", 30), (1, "d01", 30), (1, "d02", 30), (2, "y", 2), (2, "z", 2)]
    assert transcripts.first_digests(got.limit(0).select("session_id", "digest"), 3).count() == 0


@pytest.mark.parametrize("split", [7, 1 << 20])
def test_transcript_files(spark, tmp_path, split):
    """Nested and plain content, a session named by its file, broken and half-written lines; bytes are cut anywhere."""
    rows = [
        {"type": "user", "timestamp": "t1", "cwd": "/w", "message": {"role": "user", "content": "h\u00e9llo"}},
        {"type": "assistant", "timestamp": "t2", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "so"}, {"type": "tool_use", "id": "a", "name": "Bash", "input": {"x": [1]}}]}},
        {"type": "user", "timestamp": "t3", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": "out"}]}},
        {"type": "user", "timestamp": "t4", "sessionId": "other", "message": {"role": "user", "content": "x"}},
    ]
    text = "".join(json.dumps(r, ensure_ascii=False) + "\n\n{broken\n" for r in rows) + json.dumps(rows[0])
    (tmp_path / "s1.jsonl").write_text(text, encoding="utf-8")
    found = transcripts.from_lines(lines.read(spark, f"file://{tmp_path}", splitBytes=split))
    assert [(r.session_id, r.record.timestamp) for r in found.orderBy("ord").collect()] == [("s1", "t1"), ("s1", "t2"), ("s1", "t3"), ("other", "t4")]
    assert [(r.role, r.text, r.tool_calls) for r in transcripts.messages(found).orderBy("ord").collect()] == [("user", "h\u00e9llo", 0), ("assistant", "so", 1), ("user", "out", 0), ("user", "x", 0)]
    assert [tuple(r) for r in transcripts.tool_pairs(found).collect()] == [("s1", "a", "Bash", "success")]


@pytest.mark.parametrize("name", ["j2_pair_stream", "j2_pair_files"])
def test_calls_of_long_conversations_are_paired(spark, tmp_path, name):
    """A conversation of 250 turns, in which some calls are not answered, and short ones: pairs are those of the SQL."""
    import duckdb

    from mnemospark import plans

    rows = [(1, k, "user" if k % 2 == 0 and k % 22 else "assistant", f"text {k}") for k in range(250)] + [(c, k, ("system", "user", "assistant")[k % 3], "text") for c in range(2, 9) for k in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ["session_id", "id", "result"]
    got = sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).select(columns).collect()))
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLES[name]})").fetchall())
    assert got == want and ("unanswered" in {r for *_, r in want}) == (name == "j2_pair_stream") and max(int(i.split("-")[1]) for _, i, _ in want) > 200
