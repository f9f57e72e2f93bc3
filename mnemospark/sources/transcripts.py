"""Agent transcripts: normalised sessions and messages, tool calls paired with their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import jsonl

#: Record types without conversation, and tools whose calls tell nothing.
SKIPPED = ["file-history-snapshot", "permission-mode", "attachment", "queue-operation", "last-prompt", "ai-title", "pr-link", "agent-name", "system"]
LOW_SIGNAL = ["TodoWrite", "ToolSearch"]
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,is_error:boolean,content:string>"
RECORD = f"type string, timestamp string, sessionId string, cwd string, gitBranch string, message struct<role:string,model:string,content:string>"


def from_lines(lines: DataFrame) -> DataFrame:
    """(session_id, ord, record) of lines (file, offset, line), as ``lines.read`` and ``lines.stream`` give them of transcript files.

    A record's place is its line's first byte. A record without a session's id belongs to the session that its file is named after. Content may be
    text or nested blocks. Blank lines and lines that hold no object are left out.
    """
    name = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return jsonl.parse(lines, RECORD).where("status = 'ok'").select(F.coalesce("record.sessionId", name).alias("session_id"), F.col("offset").alias("ord"), "record")


def blocks(content: Column) -> Column:
    """A message's content as blocks; plain text is one text block."""
    listed = F.from_json(content, f"array<{BLOCK}>")
    plain = F.array(F.from_json(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), content)), BLOCK))
    return F.when(F.ltrim(content).startswith("["), listed).when(content.isNotNull(), plain)


def messages(records: DataFrame) -> DataFrame:
    """(session_id, ord, role, text, tool_calls, timestamp) of records (session_id, ord, record) with something said or called."""
    r = F.col("record")
    parts = F.transform(blocks(r["message"]["content"]), lambda b: F.coalesce(F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "tool_result", b["content"]), F.lit("")))
    text = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    calls = F.size(F.filter(F.coalesce(blocks(r["message"]["content"]), F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "tool_use"))
    rows = records.where(r["type"].isin("user", "assistant") & r["message"].isNotNull()).select("session_id", "ord", r["type"].alias("role"), F.coalesce(text, F.lit("")).alias("text"), calls.alias("tool_calls"), r["timestamp"].alias("timestamp"))
    return rows.where((F.trim("text") != "") | ((F.col("role") == "assistant") & (F.col("tool_calls") > 0)))


def sessions(records: DataFrame) -> DataFrame:
    """One row a session: first known place and model, span, messages, and a quarter of a token for each character."""
    r = F.col("record")
    seen = records.where(~F.coalesce(r["type"], F.lit("")).isin(SKIPPED))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("ord")))
    heads = seen.groupBy("session_id").agg(first(r["cwd"]).alias("cwd"), first(r["gitBranch"]).alias("branch"), first(r["message"]["model"]).alias("model"), F.min(r["timestamp"]).alias("started_at"), F.max(r["timestamp"]).alias("ended_at"))
    said = messages(seen).groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))
    return heads.join(said, "session_id")


def calls_and_results(records: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(session_id, id, tool, used) of calls that tell something, and (session_id, id, failed, got) of results; ``used`` and ``got`` are places."""
    b = records.select("session_id", "ord", *more, F.col("record.type").alias("kind"), F.posexplode(blocks(F.col("record.message.content"))).alias("pos", "b"))
    at, kept = F.struct("ord", "pos"), [c for c in b.columns if c not in ("session_id", "ord", "kind", "pos", "b")]
    uses = b.where("kind = 'assistant' and b.type = 'tool_use'").where(~F.col("b.name").isin(LOW_SIGNAL)).select("session_id", F.col("b.id").alias("id"), F.col("b.name").alias("tool"), at.alias("used"), *kept)
    results = b.where("kind = 'user' and b.type = 'tool_result'").select("session_id", F.col("b.tool_use_id").alias("id"), F.coalesce("b.is_error", F.lit(False)).alias("failed"), at.alias("got"), *kept)
    return uses, results


def paired(records: DataFrame, when: Column, within: str) -> DataFrame:
    """``tool_pairs`` of a stream: (session_id, id, tool, result), a row as soon as a call's result comes; "unanswered" if none came ``within`` the interval.

    Calls and results are joined on session and id with watermarks on ``when``, their event times. So state holds what is younger than the
    interval, and a call's failure to be answered is known once the watermark passes it. Of repeats of an id in a session the first call and the first
    result to arrive within the interval count. Rows later than the watermark are dropped, and rows without a time are none.
    """
    # All records move the watermark, not those alone that call or answer.
    uses, results = calls_and_results(records.withColumn("__when", when).withWatermark("__when", within), F.col("__when").alias("when"))
    once = lambda rows: rows.dropDuplicatesWithinWatermark(["session_id", "id"])
    uses, results = once(uses).alias("u"), once(results).alias("r")
    same = (F.col("u.session_id") == F.col("r.session_id")) & (F.col("u.id") == F.col("r.id")) & (F.col("u.used") < F.col("r.got"))
    near = (F.col("r.when") >= F.col("u.when")) & (F.col("r.when") <= F.col("u.when") + F.expr(f"INTERVAL {within}"))
    result = F.when(F.col("r.id").isNull(), "unanswered").when(F.col("r.failed"), "failure").otherwise("success")
    return uses.join(results, same & near, "left").select("u.session_id", "u.id", "u.tool", result.alias("result"))


def tool_pairs(records: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Tool calls with the first result that follows, by id within a session; calls of low signal and ids in ``seen`` are left out."""
    uses, results = calls_and_results(records)
    pairs = uses.join(results, ["session_id", "id"]).where(F.col("used") < F.col("got"))
    first = pairs.groupBy("session_id", "id").agg(F.min_by(F.struct("tool", "failed"), F.struct("got", "used")).alias("p")).select("session_id", "id", "p.tool", F.when(F.col("p.failed"), "failure").otherwise("success").alias("result"))
    return first if seen is None else first.join(seen, "id", "left_anti")


def first_digests(digests: DataFrame, k: int) -> DataFrame:
    """(session_id, digest, digests): the first ``k`` digests of each session by name, and how many it has.

    Of a session's digests, each task hands on its first ``k`` and a count: a session with many gathers no list. Repeats count once.
    """
    rows = digests.select("session_id", "digest").distinct()
    many = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("digests"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("digest"))).where(F.col("place") <= k)
    return first.join(many, "session_id").select("session_id", "digest", "digests")


def history_time(ts: Column) -> Column:
    """Seconds or, from a trillion on, milliseconds."""
    return F.timestamp_seconds(F.when(ts >= 1e12, ts / 1000).otherwise(ts))


def unseen(items: DataFrame, *known: DataFrame, key: str = "id") -> DataFrame:
    """Items whose key is in none of the known tables."""
    for k in known:
        items = items.join(k.select(key), key, "left_anti")
    return items


def changed(now: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions (session_id, sha) that differ from the last entry of the log (ord, session_id, sha)."""
    last = log.groupBy("session_id").agg(F.max_by("sha", "ord").alias("sha"))
    return now.join(last, ["session_id", "sha"], "left_anti")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose time or size is not as it was."""
    return now.join(before, ["path", "mtime", "size"], "left_anti")


def numbered(lines: DataFrame, order: str) -> DataFrame:
    return lines.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy(order)))
