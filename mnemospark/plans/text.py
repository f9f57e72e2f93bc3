"""Queries of scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import ids, score, text
from ..operators.redact import char_entropy
from ..session import AS_OF, moment
from .registry import query

STOP1, STOP2, STOP3 = ("[" + ", ".join(f"'{w}'" for w in s) + "]" for s in (text.STOP_WORDS, text.STOP_PROMPT, text.STOP_TERMS))
WORDSET = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[a-zA-Z][a-zA-Z0-9_-]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains(" + STOP1 + ", x))))"
PROMPT = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-_]+'), lambda x: NOT list_contains(" + STOP2 + ", x))))"
TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda x: length(x) > 1 AND NOT list_contains(" + STOP3 + ", x))"
CLAIM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def documents(spark, sf):
    return views.spread(views.table(spark, sf, "documents"))


def joined(tokens):
    return F.array_join(tokens, " ")


@query("f1_word_set", f"SELECT doc_id, len({WORDSET.format('text')}) AS n, array_to_string({WORDSET.format('text')}, ' ') AS words FROM documents")
def f1(spark, sf):
    return documents(spark, sf).select("doc_id", text.word_set(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), joined("w").alias("words"))


@query("f2_prompt_tokens", f"SELECT doc_id, array_to_string({PROMPT.format('text')}, ' ') AS tokens FROM documents")
def f2(spark, sf):
    return documents(spark, sf).select("doc_id", joined(text.prompt_tokens(F.col("text"))).alias("tokens"))


@query("f3_terms", f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS t FROM documents) GROUP BY 1, 2")
def f3(spark, sf):
    return text.term_counts(documents(spark, sf), "doc_id", "text")


@query("f4_overlap_words", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(translate(lower(text), '/:', '  '), '\\s+'), lambda x: length(x) > 2)) AS BIGINT) AS n FROM documents")
def f4(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(text.overlap_words(F.col("text"))).cast("long").alias("n"))


TOKENS = r"CAST(list_sum(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda x: CASE WHEN regexp_matches(x, '^[\p{{L}}\p{{N}}_]') THEN greatest(1, length(x) // 4) ELSE 1 END)) AS BIGINT)"


@query("f5_token_estimate", f"SELECT doc_id, coalesce({TOKENS.format('text')}, 0) AS tokens FROM documents")
def f5(spark, sf):
    return documents(spark, sf).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("f6_quarter_estimate", "SELECT conv_id, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def f6(spark, sf):
    return views.table(spark, sf, "conversations").groupBy("conv_id").agg(F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))


AGE = f"greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0))"
SALIENCE = f"greatest(0.0, least(10.0, 10.0 - {AGE} * 0.3)) * (pain_score / 10.0) * (importance / 10.0)"


@query("f7_salience", views.with_views("ep", f"SELECT ord, round({SALIENCE} * least(user_id % 5 + 1, 3), 6) AS salience FROM ep"))
def f7(spark, sf):
    s = score.salience(F.col("ts"), F.col("pain_score"), F.col("importance"), F.col("user_id") % 5 + 1, moment())
    return views.episodes(spark, sf).select("ord", F.round(s, 6).alias("salience"))


@query("f8_priority", views.with_views("ep", f"""SELECT ord, round(greatest(1, tokens_out) * greatest(0.1, {SALIENCE}) * (1.0 + least(1.0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0) / 14.0)), 6) AS priority FROM ep"""))
def f8(spark, sf):
    s = score.salience(F.col("ts"), F.col("pain_score"), F.col("importance"), F.lit(1), moment())
    return views.episodes(spark, sf).select("ord", F.round(score.priority(F.col("tokens_out"), s, F.col("ts"), moment()), 6).alias("priority"))


@query("f9_normalized_claim", f"SELECT doc_id, md5({CLAIM.format('text')}) AS claim FROM documents")
def f9(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.normalized_claim(F.col("text"))).alias("claim"))


@query("f11_pattern_id", f"""SELECT doc_id, substr(md5({CLAIM.format('text')} || '||' || CASE WHEN lang < source THEN lang || '|' || source ELSE source || '|' || lang END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '||origin=team.inbox' END), 1, 12) AS id FROM documents""")
def f11(spark, sf):
    origin = F.when(F.col("doc_id") % 2 == 0, ids.DEFAULT_ORIGIN).otherwise("team.inbox")
    conditions = F.array(F.concat(F.lit(" "), F.upper("source")), F.col("lang"), F.lit("​"), F.col("source"))
    return documents(spark, sf).select("doc_id", ids.pattern_id(F.col("text"), conditions, origin).alias("id"))


@query("f12_claim_ids", views.with_views("ob", """SELECT event_id, sha256(topic_key || chr(0) || claim_subject || chr(0) || event_id) AS claim_id, sha256(topic_key || chr(0) || claim_subject || chr(0) || value) AS fingerprint,
  sha256(event_id || chr(0) || topic_key || chr(0) || 'supersede' || chr(0) || 'newer_source_ts') AS transition_id FROM ob"""))
def f12(spark, sf):
    o, c = views.observations(spark, sf), F.col
    return o.select("event_id", ids.claim_id(c("topic_key"), c("claim_subject"), c("event_id")).alias("claim_id"), ids.fingerprint(c("topic_key"), c("claim_subject"), c("value")).alias("fingerprint"), ids.transition_id(c("event_id"), c("topic_key"), "supersede", "newer_source_ts").alias("transition_id"))


@query("f13_event_ids", views.with_views("ep", "SELECT ord, substr(sha256(skill || '|' || CAST(ord AS VARCHAR) || '|' || action), 1, 16) AS event_id, 'c-' || substr(sha256(action), 1, 16) AS content_id FROM ep"))
def f13(spark, sf):
    return views.episodes(spark, sf).select("ord", ids.event_id(F.col("skill"), F.col("ord"), F.col("action")).alias("event_id"), ids.content_id(F.col("action")).alias("content_id"))


@query("f14_uuid5", views.with_views("md", """SELECT path, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT path, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path)) AS h FROM md)"""))
def f14(spark, sf):
    return views.memory_docs(spark, sf).select("path", ids.uuid5(F.col("path")).alias("id"))


@query("f17_entropy", """SELECT doc_id, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p
FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id, ch) GROUP BY 1""")
def f17(spark, sf):
    """Characters are counted within each row."""
    return documents(spark, sf).where(F.length("text") > 0).select("doc_id", F.round(char_entropy(F.col("text")), 6).alias("bits"))


@query("f23_substitutions", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS BIGINT) AS the, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS num, md5(regexp_replace(regexp_replace(text, '(?i)\\bthe\\b', '<t>', 'g'), '[0-9]+', '<n>', 'g')) AS scrubbed FROM documents")
def f23(spark, sf):
    subs = [("the", r"(?i)\bthe\b", "<t>"), ("num", "[0-9]+", "<n>")]
    out, hits = F.col("text"), []
    for name, pattern, put in subs:
        hits.append(F.regexp_count(out, F.lit(pattern)).cast("long").alias(name))
        out = F.regexp_replace(out, pattern, put)
    return documents(spark, sf).select("doc_id", *hits, F.md5(out).alias("scrubbed"))


@query("f26_scrub", "SELECT doc_id, substr(replace(replace(regexp_replace(text, '\\s+', ' ', 'g'), '<', '&lt;'), '>', '&gt;'), 1, 300) AS safe FROM documents")
def f26(spark, sf):
    flat = F.regexp_replace("text", r"\s+", " ")
    return documents(spark, sf).select("doc_id", F.substring(F.replace(F.replace(flat, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), 1, 300).alias("safe"))


@query("f31_digest_path", "SELECT doc_id, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '__' || regexp_replace(substr(trim(regexp_replace(lower(substr(text, 1, 80)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-+$', '') || '__' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) || '.md' AS path FROM documents")
def f31(spark, sf):
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    return documents(spark, sf).select("doc_id", F.concat(F.lit("2024-01-"), day, F.lit("__"), text.dashed_slug(F.substring("text", 1, 80)), F.lit("__"), F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 8), F.lit(".md")).alias("path"))


@query("f33_indexed_text", "SELECT doc_id, md5(trim(source || ' ' || lang || ' ' || lang || ' ' || lang || ' ' || text)) AS h FROM documents")
def f33(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.indexed_text(F.col("source"), F.col("lang"), F.col("text"))).alias("h"))


@query("f34_truncated_context", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN md5(text) ELSE md5(substr(text, 1, 300) || '\n...\n' || right(text, 100)) END AS h FROM documents")
def f34(spark, sf):
    cut = F.concat(F.substring("text", 1, 300), F.lit("\n...\n"), F.right(F.col("text"), F.lit(100)))
    return documents(spark, sf).select("doc_id", F.md5(F.when(F.length("text") <= 400, F.col("text")).otherwise(cut)).alias("h"))


@query("f36_summary", "SELECT doc_id, substr(trim(coalesce(nullif(text, ''), source, '')), 1, 120) AS summary FROM documents")
def f36(spark, sf):
    return documents(spark, sf).select("doc_id", text.summary(F.col("text"), F.col("source")).alias("summary"))


@query("u2_jaccard", f"""SELECT a, b, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE round(CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))), 6) END AS j FROM (
  SELECT p.doc_id AS a, q.doc_id AS b, {WORDSET.format('p.text')} AS x, {WORDSET.format('q.text')} AS y FROM documents p JOIN documents q ON q.doc_id = p.doc_id + 1)""")
def u2(spark, sf):
    """Neighbours by id, by an equality join."""
    d = documents(spark, sf).select("doc_id", text.word_set(F.col("text")).alias("w"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("w").alias("y")), "doc_id")
    return pairs.select(F.col("doc_id").alias("a"), "b", F.round(text.jaccard(F.col("w"), F.col("y")), 6).alias("j"))


# --- predicates


@query("pf1_conforming", views.with_views("ob", "SELECT event_id FROM ob WHERE trim(kind) <> '' AND trim(event_id) <> '' AND source_ts IS NOT NULL AND trim(coalesce(CASE WHEN CAST(event_id AS BIGINT) % 11 <> 0 THEN value END, '')) <> ''"))
def pf1(spark, sf):
    o = views.observations(spark, sf).withColumn("value", F.when(F.col("event_id").cast("long") % 11 != 0, F.col("value")))
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return o.where(full(F.col("kind")) & full(F.col("event_id")) & F.col("source_ts").isNotNull() & full(F.col("value"))).select("event_id")


@query("pf2_watermark", views.with_views("ob", "SELECT event_id FROM ob WHERE (ts, CASE WHEN kind LIKE 'tombstone%' THEN 1 ELSE 0 END, event_id) > (880000000.0, 0, '0000000100')"))
def pf2(spark, sf):
    mark = F.struct(F.lit(880000000.0).alias("ts"), F.lit(0).alias("t"), F.lit("0000000100").alias("id"))
    row = F.struct(F.col("ts").alias("ts"), F.when(F.col("kind").startswith("tombstone"), 1).otherwise(0).alias("t"), F.col("event_id").alias("id"))
    return views.observations(spark, sf).where(row > mark).select("event_id")


@query("pf6_payload_filter", views.with_views("md", "SELECT path FROM md WHERE type = 'fr' AND source = 'src3'"))
def pf6(spark, sf):
    return views.memory_docs(spark, sf).where((F.col("type") == "fr") & (F.col("source") == "src3")).select("path")


@query("pf7_source_scope", "SELECT DISTINCT source FROM documents WHERE source NOT IN ('src1', 'src2')")
def pf7(spark, sf):
    return documents(spark, sf).where(~F.col("source").isin("src1", "src2")).select("source").distinct()


ACK = "[" + ", ".join(f"'{a}'" for a in score.ACKS) + "]"


@query("pf8_skip", f"""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 40 THEN 'too_short' WHEN starts_with(trim(text), '/') THEN 'slash' WHEN list_contains({ACK}, regexp_replace(lower(trim(text)), '[ !.?,]+$', '')) THEN 'ack' END AS reason FROM conversations WHERE role = 'user'""")
def pf8(spark, sf):
    return views.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", score.skip_reason(F.col("text"), 40).alias("reason"))


@query("pf9_min_score", views.with_views("ep", "SELECT ord, value FROM (SELECT ord, round(tokens_out / 100.0, 6) AS value FROM ep) WHERE value >= 0.7"))
def pf9(spark, sf):
    return views.episodes(spark, sf).select("ord", F.round(F.col("tokens_out") / 100.0, 6).alias("value")).where("value >= 0.7")


@query("pf12_heuristic_gate", f"""SELECT conv_id, turn, length(c) < 20 AS too_short, len({WORDSET.format('c')}) < 3 AS few_words, round_even(0.5 * least(1.0, length(c) / 100.0) + 0.5 * least(1.0, (turn % 7) / 5.0), 3) AS confidence FROM (SELECT conv_id, turn, trim(text) AS c FROM conversations)""")
def pf12(spark, sf):
    confidence = F.bround(0.5 * F.least(F.lit(1.0), F.length("c") / 100.0) + 0.5 * F.least(F.lit(1.0), (F.col("turn") % 7) / 5.0), 3)
    said = views.table(spark, sf, "conversations").select("conv_id", "turn", F.trim("text").alias("c"))
    return said.select("conv_id", "turn", (F.length("c") < 20).alias("too_short"), (F.size(text.word_set(F.col("c"))) < 3).alias("few_words"), confidence.alias("confidence"))


@query("pf13_promotion", views.with_views("ep", f"SELECT ord FROM ep WHERE round({SALIENCE} * 3, 6) >= 7.0"))
def pf13(spark, sf):
    s = score.salience(F.col("ts"), F.col("pain_score"), F.col("importance"), F.lit(3), moment())
    return views.episodes(spark, sf).where(F.round(s, 6) >= 7.0).select("ord")


@query("pf15_review_reconcile", views.with_views("md", "SELECT coalesce(f.path, l.path) AS path, CASE WHEN l.path IS NULL THEN 'clear' WHEN f.path IS NULL THEN 'mark' ELSE 'keep' END AS action FROM (SELECT path FROM md WHERE needs_review) f FULL JOIN (SELECT path FROM md WHERE length(body) < 300) l ON f.path = l.path"))
def pf15(spark, sf):
    d = views.memory_docs(spark, sf)
    flagged, found = d.where("needs_review").select("path", F.lit(1).alias("f")), d.where(F.length("body") < 300).select("path", F.lit(1).alias("l"))
    return flagged.join(found, "path", "full_outer").select("path", F.when(F.col("l").isNull(), "clear").when(F.col("f").isNull(), "mark").otherwise("keep").alias("action"))


@query("pf24_labels", views.with_views("ep", "SELECT ord, CASE action WHEN 'view' THEN 'Read page ' || CAST(tokens_out AS VARCHAR) WHEN 'click' THEN 'Ran: click ' || CAST(tokens_out AS VARCHAR) WHEN 'error' THEN 'FAILURE in ' || skill || ': code ' || CAST(tokens_out AS VARCHAR) ELSE 'Tool ' || action || ' completed successfully' END AS reflection FROM ep"))
def pf24(spark, sf):
    k = F.col("tokens_out").cast("string")
    label = F.when(F.col("action") == "view", F.concat(F.lit("Read page "), k)).when(F.col("action") == "click", F.concat(F.lit("Ran: click "), k)).when(F.col("action") == "error", F.concat(F.lit("FAILURE in "), "skill", F.lit(": code "), k)).otherwise(F.concat(F.lit("Tool "), "action", F.lit(" completed successfully")))
    return views.episodes(spark, sf).select("ord", label.alias("reflection"))


@query("pf26_origin", views.with_views("ep", "SELECT ord, coalesce(nullif(CASE WHEN ord % 3 = 0 THEN '' WHEN ord % 3 = 1 THEN origin END, ''), 'coding.tool_call') AS origin FROM ep"))
def pf26(spark, sf):
    raw = F.when(F.col("ord") % 3 == 0, "").when(F.col("ord") % 3 == 1, F.col("origin"))
    return views.episodes(spark, sf).select("ord", F.coalesce(F.nullif(raw, F.lit("")), F.lit(ids.DEFAULT_ORIGIN)).alias("origin"))


@query("pf29_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'with') OR contains(lower(source), 'src1') ORDER BY doc_id DESC LIMIT 25")
def pf29(spark, sf):
    return documents(spark, sf).where(F.lower("text").contains("with") | F.lower("source").contains("src1")).select("doc_id").orderBy(F.desc("doc_id")).limit(25)


@query("pf30_sync_status", views.with_views("ep", """SELECT skill, CASE WHEN contains(last, 'error') THEN 'blocked' WHEN age > 7200 THEN 'stale' ELSE 'ok' END AS status FROM (
  SELECT skill, max_by(action, ord) AS last, epoch(TIMESTAMP '2024-01-30 20:00:00') - max(epoch(ts)) AS age FROM ep GROUP BY 1)"""))
def pf30(spark, sf):
    last = views.episodes(spark, sf).groupBy("skill").agg(F.max_by("action", "ord").alias("last"), F.max("ts").alias("at"))
    age = F.unix_seconds(moment("2024-01-30 20:00:00").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) / 1e6
    return last.select("skill", F.when(F.col("last").contains("error"), "blocked").when(age > 7200, "stale").otherwise("ok").alias("status"))
