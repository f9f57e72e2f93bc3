"""Queries of sources, sinks, redaction and lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import score
from ..operators import claims as C
from ..operators import extract as X
from ..operators import lint as L
from ..operators import redact as R
from ..operators.ordered import row_numbers
from ..sources import jsonl, transcripts
from .claims import moves_sql, with_claims
from .registry import query

EVENT = "event_id long, event_type string, value double, schema_version string"


def raw_lines(spark, sf):
    """The events as lines of JSON, some blank, cut short, no object, or of a future version."""
    e = views.table(spark, sf, "events")
    version = F.when(F.col("event_id") % 10 == 3, "2").when(F.col("event_id") % 10 == 4, "x").when(F.col("event_id") % 10 == 5, "1")
    good = F.to_json(F.struct("event_id", "event_type", "value", version.alias("schema_version")))
    k = F.col("event_id") % 50
    return e.select(F.col("event_id").alias("ord"), F.when(k == 0, "  ").when(k == 1, F.substring(good, 1, 20)).when(k == 2, "[1, 2]").when(k == 6, '"text"').otherwise(good).alias("line"))


@query("sc1_jsonl", "SELECT event_id, event_type FROM events WHERE event_id % 50 NOT IN (0, 1, 2, 6)")
def sc1(spark, sf):
    return jsonl.read(raw_lines(spark, sf), EVENT).select("event_id", "event_type")


@query("sc2_jsonl_counters", "SELECT count(*) FILTER (event_id % 50 NOT IN (0, 1, 2, 6)) AS ok, count(*) FILTER (event_id % 50 = 0) AS blank, count(*) FILTER (event_id % 50 IN (1, 2, 6)) AS malformed FROM events")
def sc2(spark, sf):
    return jsonl.counted(raw_lines(spark, sf), EVENT)


@query("sc3_versioned_read", "SELECT event_id FROM events WHERE event_id % 50 NOT IN (0, 1, 2, 6) AND event_id % 10 <> 3")
def sc3(spark, sf):
    return jsonl.read(raw_lines(spark, sf), EVENT).where(jsonl.known_version(F.col("schema_version"))).select("event_id")


def records(spark, sf):
    """Conversations as transcript records, with a tool call in every assistant turn and its result in the user turn after."""
    c = views.table(spark, sf, "conversations")
    call = F.concat(F.lit("t"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    back = F.concat(F.lit("t"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1)
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    use = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), call.alias("id"), F.when(F.col("turn") % 4 == 3, "TodoWrite").otherwise("Bash").alias("name"))))
    result = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), back.alias("tool_use_id"), (F.col("conv_id") % 3 == 0).alias("is_error"), F.lit("out").alias("content"), F.lit(None).cast("string").alias("text")), F.struct(text["type"].alias("type"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("content"), F.col("text").alias("text"))))
    content = F.when(F.col("role") == "assistant", use).when((F.col("role") == "user") & (F.col("turn") > 0), result).otherwise(F.col("text"))
    stamp = F.concat(F.lit("2024-01-01T00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00Z"))
    record = F.struct(F.col("role").alias("type"), stamp.alias("timestamp"), F.col("conv_id").cast("string").alias("sessionId"), F.when(F.col("turn") > 0, F.lit("/work")).alias("cwd"), F.lit(None).cast("string").alias("gitBranch"), F.struct(F.col("role").alias("role"), F.when(F.col("role") == "assistant", "m1").alias("model"), content.alias("content")).alias("message"))
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), record.alias("record"))


def timed(rows):
    """Records of ``records`` whose time is as many minutes after the first as their turn, however long the conversation. Their own
    stamps, which ``sc11_sessions`` shows, have two digits for the turn: from turn 60 on they are no times, and from 100 on those of other turns."""
    turn, two = F.col("ord"), lambda n: F.lpad(n.cast("string"), 2, "0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(turn / 1440).cast("int")).cast("string")
    stamp = F.concat(day, F.lit("T"), two(F.floor(turn % 1440 / 60)), F.lit(":"), two(turn % 60), F.lit(":00Z"))
    return rows.withColumn("record", F.col("record").withField("timestamp", stamp))


@query("sc11_sessions", """SELECT conv_id AS session_id, max(CASE WHEN turn > 0 THEN '/work' END) AS cwd, max(CASE WHEN role = 'assistant' THEN 'm1' END) AS model, count(*) AS messages, CAST(sum(length(text) + CASE WHEN role = 'user' AND turn > 0 THEN 4 ELSE 0 END) // 4 AS BIGINT) AS tokens,
  min('2024-01-01T00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00Z') AS started_at, max('2024-01-01T00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00Z') AS ended_at FROM conversations WHERE role <> 'system' GROUP BY 1""")
def sc11(spark, sf):
    return transcripts.sessions(records(spark, sf)).select("session_id", "cwd", "model", "messages", "tokens", "started_at", "ended_at")


@query("sc12_rollouts", "SELECT conv_id AS session_id, count(*) FILTER (role IN ('user', 'assistant')) AS messages, CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN length(text) ELSE 0 END) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def sc12(spark, sf):
    """Rollouts keep text in payload.content; session metadata comes in a record of its own."""
    c = views.table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("payload")))
    r = F.from_json(line, "type string, payload struct<type:string,role:string,content:array<struct<type:string,text:string>>>")
    said = c.select("conv_id", r.alias("r")).select("conv_id", F.col("r.payload.role").isin("user", "assistant").alias("ok"), F.array_join(F.col("r.payload.content.text"), "\n").alias("text"))
    return said.groupBy(F.col("conv_id").alias("session_id")).agg(F.count_if("ok").alias("messages"), F.floor(F.sum(F.when(F.col("ok"), F.length("text")).otherwise(0)) / 4).cast("long").alias("tokens"))


@query("sc14_history_times", "SELECT event_id, epoch_ms(CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE (epoch_us(ts) // 1000000) * 1000 END) AS moment FROM events")
def sc14(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 2 == 0, ms).otherwise(F.floor(ms / 1000)).cast("double")
    return views.table(spark, sf, "events").select("event_id", transcripts.history_time(raw).cast("timestamp_ntz").alias("moment"))


@query("sc15_changed_files", "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR doc_id % 14 = 0")
def sc15(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    before = d.where("doc_id % 14 <> 0").select("path", F.when(F.col("doc_id") % 9 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    return transcripts.changed_files(d, before).select("doc_id")


@query("sc17_candidate_sources", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def sc17(spark, sf):
    return views.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


@query("sk9_lessons_rewrite", views.with_views("ep", "SELECT skill AS id, arg_max(action, ord) AS claim, row_number() OVER (ORDER BY skill) AS place FROM ep GROUP BY 1"))
def sk9(spark, sf):
    last = views.episodes(spark, sf).groupBy(F.col("skill").alias("id")).agg(F.max_by("action", "ord").alias("claim"))
    return row_numbers(last, ["id"], "place").select("id", "claim", "place")


@query("sk6_dual_rows", views.with_views("md", "SELECT m.path, m.type, coalesce(o.needs_review, false) AS needs_review FROM md m LEFT JOIN (SELECT path, needs_review FROM md WHERE doc_id % 2 = 0) o USING (path)"))
def sk6(spark, sf):
    """What both sinks are written from: new documents, with the review flag carried over from the old ones."""
    d = views.memory_docs(spark, sf)
    old = d.where("doc_id % 2 = 0").select("path", F.col("needs_review").alias("old"))
    return d.join(old, "path", "left").select("path", "type", F.coalesce("old", F.lit(False)).alias("needs_review"))


# Assistant turns of odd number call; the user turn after them answers.
@query("j2_tool_pairs", """SELECT a.conv_id AS session_id, 't' || CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS id, CASE WHEN a.conv_id % 3 = 0 THEN 'failure' ELSE 'success' END AS result FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user'
WHERE a.role = 'assistant' AND a.turn % 4 <> 3 AND a.conv_id % 5 <> 0""")
def j2(spark, sf):
    seen = views.table(spark, sf, "conversations").where("conv_id % 5 = 0").select(F.concat(F.lit("t"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"))
    return transcripts.tool_pairs(records(spark, sf), seen).select("session_id", "id", "result")


@query("j6_drift", "SELECT area, path, status FROM (SELECT coalesce(a.source, b.source) AS area, CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS path, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN CASE WHEN b.source <> 'src0' THEN 'extra' END WHEN a.n_chars <> b.n_chars THEN 'stale' END AS status FROM (SELECT * FROM documents WHERE doc_id % 6 <> 0) a FULL JOIN (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0) b USING (doc_id)) WHERE status IS NOT NULL")
def j6(spark, sf):
    d = views.table(spark, sf, "documents").select(F.col("source").alias("area"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("sha"), "doc_id")
    live = d.where("doc_id % 5 <> 0").withColumn("sha", F.when(F.col("doc_id") % 7 == 0, F.col("sha") + 1).otherwise(F.col("sha")))
    return L.drift(d.where("doc_id % 6 <> 0"), live, "src0")


@query("j9_trace", "SELECT c.conv_id AS session_id, d.doc_id FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN documents d ON d.doc_id IN (c.conv_id, c.conv_id + 1) AND contains(substr('session-' || CAST(c.conv_id AS VARCHAR) || ' ' || d.text, 1, 4096), 'session-' || CAST(c.conv_id AS VARCHAR) || ' ')")
def j9(spark, sf):
    """Digests name their session in the file's name or at the head of the text: the id is extracted and joined on equality, no pair is searched."""
    c = views.table(spark, sf, "conversations").select("conv_id").distinct()
    d = views.table(spark, sf, "documents")
    made = d.select("doc_id", F.explode(F.array(F.col("doc_id"), F.col("doc_id") - 1)).alias("s"), "text").select("doc_id", F.concat(F.lit("session-"), F.col("s"), F.lit(" "), "text").alias("digest"))
    named = made.select("doc_id", F.explode(F.regexp_extract_all(F.substring("digest", 1, 4096), F.lit(r"session-(\d+) "), F.lit(1))).alias("s"))
    return c.join(named, F.col("conv_id") == F.col("s").try_cast("long")).select(F.col("conv_id").alias("session_id"), "doc_id").distinct()


@query("j9_top_digests", """SELECT session_id, digest, digests FROM (SELECT conv_id AS session_id, 'digest-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS digest, count(*) OVER (PARTITION BY conv_id) AS digests, row_number() OVER (PARTITION BY conv_id ORDER BY doc_id) AS place
  FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN documents d ON d.doc_id % (SELECT count(DISTINCT conv_id) FROM conversations) = c.conv_id) WHERE place <= 3""")
def j9_top(spark, sf):
    """The first three digests of each session by name, and how many it has. Sessions' ids stand in the digests' names here; documents are dealt to sessions in turn."""
    c = views.table(spark, sf, "conversations").select("conv_id").distinct()
    n = max(1, c.count())
    d = views.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("session-"), F.col("doc_id") % n, F.lit(" of ")).alias("line"))
    named = d.select(F.format_string("digest-%08d.md", "doc_id").alias("digest"), F.regexp_extract("line", r"session-(\d+) ", 1).try_cast("long").alias("conv_id"))
    return transcripts.first_digests(c.join(named, "conv_id").select(F.col("conv_id").alias("session_id"), "digest"), 3)


@query("j10_rule_join", views.with_views("ep", "SELECT ord, coalesce(min_by(cat, r.k), 'none') AS category FROM ep LEFT JOIN (VALUES (1, 9, 'top'), (2, 6, 'mid'), (3, 3, 'low')) r(k, least, cat) ON importance >= least GROUP BY ord"))
def j10(spark, sf):
    """Rules in a table: three rows, broadcast; the first that fits by its place."""
    rules = spark.createDataFrame([(1, 9, "top"), (2, 6, "mid"), (3, 3, "low")], "k int, least int, cat string")
    e = views.episodes(spark, sf).select("ord", "importance")
    return e.join(F.broadcast(rules), F.col("importance") >= F.col("least"), "left").groupBy("ord").agg(F.coalesce(F.min_by("cat", "k"), F.lit("none")).alias("category"))


@query("j12_unseen", "SELECT event_id AS id FROM events WHERE event_id % 2 <> 0 AND event_id % 3 <> 0")
def j12(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return transcripts.unseen(e, e.where("id % 2 = 0"), e.where("id % 3 = 0"))


@query("j13_changed_sessions", "SELECT conv_id AS session_id FROM conversations GROUP BY 1 HAVING conv_id % 4 = 0")
def j13(spark, sf):
    c = views.table(spark, sf, "conversations")
    now = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.sha1("text").alias("h")))), lambda x: x["h"]), ""), 256).alias("sha"))
    log = now.select(F.lit(2).alias("ord"), "session_id", F.when(F.col("session_id") % 4 == 0, "old").otherwise(F.col("sha")).alias("sha")).union(now.select(F.lit(1), "session_id", F.lit("older")))
    return transcripts.changed(now, log).select("session_id")


# Whole documents, seven of eight with a secret made of the id at their end.
PLANTED = """(SELECT doc_id, text || chr(10) || CASE doc_id % 8 WHEN 0 THEN 'key AKIA' || upper(substr(h, 1, 16)) WHEN 1 THEN 'MY_TOKEN = ''' || h || '''' WHEN 2 THEN 'Authorization: Bearer ' || h
  WHEN 3 THEN 'see https://user:' || substr(h, 1, 12) || '@host/x' WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || h || chr(10) || '-----END RSA PRIVATE KEY-----'
  WHEN 5 THEN 'AKIA' || upper(substr(h, 1, 16)) || ' # redact-allow' WHEN 6 THEN 'sk_live_' || h ELSE '' END AS text FROM (SELECT doc_id, text, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents))"""


def texts(spark, sf):
    h, k = F.md5(F.col("doc_id").cast("string")), F.col("doc_id") % 8
    id_key = F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))
    secret = (
        F.when(k == 0, F.concat(F.lit("key "), id_key)).when(k == 1, F.concat(F.lit("MY_TOKEN = '"), h, F.lit("'"))).when(k == 2, F.concat(F.lit("Authorization: Bearer "), h))
        .when(k == 3, F.concat(F.lit("see https://user:"), F.substring(h, 1, 12), F.lit("@host/x"))).when(k == 4, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), h, F.lit("\n-----END RSA PRIVATE KEY-----")))
        .when(k == 5, F.concat(id_key, F.lit(" # redact-allow"))).when(k == 6, F.concat(F.lit("sk_live_"), h)).otherwise("")
    )
    return views.spread(views.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.lit("\n"), secret).alias("text"))


def sql_text(pattern):
    return pattern.replace("'", "''")


_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, unnest(regexp_extract_all(text, '{sql_text(p)}', {R.GROUPS.get(n, 0)})) AS s FROM planted" for n, p in R.PATTERNS)
_REDACTED = "text"
for _n, _p, _parts in R.RULES:
    _put = "".join(f"\\{x}" if x.isdigit() else x for x in _parts)
    _REDACTED = f"regexp_replace({_REDACTED}, '{sql_text(_p)}', '{_put}', 'g')"


@query("f18_secret_detection", f"WITH planted AS {PLANTED} SELECT doc_id, name, count(*) AS n FROM ({_FOUND}) GROUP BY 1, 2")
def f18(spark, sf):
    return R.detect(texts(spark, sf)).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("f18_secret_scan")
def f18_scan(spark, sf):
    """Line and kind of each secret of all documents, with overlaps, allowed lines, blocks and entropy."""
    return R.scanned(texts(spark, sf)).select("doc_id", "line", "name", "secret")


@query("f19_redaction", f"SELECT doc_id, md5({_REDACTED}) AS redacted FROM {PLANTED}")
def f19(spark, sf):
    """Whole texts under all rules."""
    return R.redacted(texts(spark, sf)).select("doc_id", F.md5("text").alias("redacted"))


@query("f19_redaction_all", f"SELECT conv_id, turn, {_REDACTED} AS text FROM conversations")
def f19_all(spark, sf):
    return R.redacted(views.table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "text")


@query("f20_json_scrub")
def f20(spark, sf):
    """Messages as JSON with nested strings; every seventh line is cut short, and redacted as text."""
    j = F.to_json(F.struct("turn", F.struct(F.array("role", "text").alias("parts")).alias("message")))
    rows = views.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, F.substring(j, F.lit(1), F.length(j) - 3)).otherwise(j).alias("j"))
    return rows.select("conv_id", "turn", R.scrub_json("j").alias("r")).select("conv_id", "turn", "r.json", "r.hits")


@query("f21_write_path_redaction")
def f21(spark, sf):
    """What a write path does to whole texts: all rules, then noisy tokens."""
    return R.redacted(texts(spark, sf), threshold=R.THRESHOLD).select("doc_id", F.md5("text").alias("redacted"), F.array_join("hits", ",").alias("hits"))


@query("x9_query_variants", """SELECT item_id AS qid, 0 AS variant, text AS query FROM benchmark UNION ALL
SELECT item_id, 1, r FROM (SELECT item_id, text, lower(array_to_string(list_reverse(regexp_split_to_array(trim(text), '\\s+')), ' ')) AS r FROM benchmark) WHERE r <> lower(trim(text))
UNION ALL SELECT item_id, 2, replace(lower(trim(text)), 'ß', 'ss') FROM benchmark WHERE contains(text, 'ß')""")
def x9(spark, sf):
    q = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return X.variants(q, lambda s: [" ".join(reversed(s.split())), s.upper(), s], 3)


@query("sk4_export_shapes", views.with_views("ep", "SELECT ord, CAST(ord AS VARCHAR) || ',' || skill || ',' || action AS csv FROM ep"))
def sk4(spark, sf):
    """CSV and JSON lines of one table; writers are Spark's own."""
    return views.episodes(spark, sf).select("ord", F.to_csv(F.struct("ord", "skill", "action")).alias("csv"))


@query("st11_digest_backfill", """SELECT conv_id AS session_id, CASE WHEN count(*) >= 3 THEN substr(arg_min(CASE WHEN role = 'user' AND turn > 0 THEN 'out' || chr(10) || text ELSE text END, turn), 1, 40) END AS title, CASE WHEN count(*) < 3 THEN 'too short' END AS error
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1""")
def st11(spark, sf):
    """One digest for each session; a session that fails gets its error, and the others go on."""
    said = transcripts.messages(records(spark, sf)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "ord").alias("first"))
    return said.select("session_id", F.when(F.col("n") >= 3, F.substring("first", 1, 40)).alias("title"), F.when(F.col("n") < 3, "too short").alias("error"))


@query("st8_consolidation", with_claims("SELECT 'assert' AS event_type, count(*) AS n FROM asr UNION ALL SELECT 'supersede', count(*) FROM mv UNION ALL SELECT 'retract', count(*) FROM gone", f", {moves_sql('asr')}"))
def st8(spark, sf):
    """One run over a batch: asserts, transitions and retracts as rows of the log to be appended."""
    o = views.observations(spark, sf)
    a = C.extract(o)
    gone = C.tombstones(o, a)
    moves = C.fold(a)
    none = F.lit(None).cast("string")
    log = a.select(F.lit("assert").alias("event_type"), "claim_id", none.alias("new_claim_id"), none.alias("reason"))
    log = log.union(moves.select(F.lit("supersede"), "old", "new", F.lit("newer_source_ts"))).union(gone.select(F.lit("retract"), "claim_id", none, "reason"))
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("st12_dream_cycle")
def st12(spark, sf):
    """Cluster, drop bursts, extract, drop narration, keep what is salient, stage against what is known."""
    from ..operators import distil as D
    from ..session import moment
    from .distil import token_rows

    rows = token_rows(spark, sf)
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("claim"), (moment() - F.make_dt_interval((F.col("doc_id") % 20).cast("int"))).alias("ts"), (F.col("doc_id") % 10 + 1).alias("pain_score"), (F.col("doc_id") % 7 + 3).alias("importance"), F.col("source").alias("skill"), F.lit("success").alias("result"))
    members = D.clustered(rows, 0.5).join(d, "ord")
    calm = D.written(D.bursts(members).where("not burst").select("cluster"))
    found = D.patterns(members.join(calm, "cluster", "left_semi"), moment()).where((score.narration(F.col("claim")) == "") & (F.col("canonical_salience") >= 7.0))
    found = D.written(found.select("id", "claim"))
    prior = found.where(F.length("claim") % 5 == 0).select(F.col("id").alias("slug"), F.lit("graduated").alias("place"), F.lit("accepted").alias("status"), F.array().cast("array<string>").alias("snapshot"), F.lit(True).alias("blocked"))
    return D.stage(found.select(F.col("id").alias("slug"), "claim", F.array("id").alias("evidence")), prior)
