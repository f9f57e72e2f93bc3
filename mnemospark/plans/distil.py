"""Queries of the distillation family."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .. import views
from ..functions import score, text
from ..operators import distil as O
from ..operators.graph import components
from ..operators.ordered import fold, row_numbers
from ..session import AS_OF, moment
from .registry import query
from .text import CLAIM, SALIENCE, WORDSET

THETA = 0.5


def token_rows(spark, sf):
    d = views.spread(views.table(spark, sf, "documents"))
    return d.select(F.col("doc_id").alias("ord"), F.col("lang").alias("origin"), text.word_set(F.col("text")).alias("tokens"))


SETS = f"""
ws AS (SELECT doc_id AS ord, lang AS origin, {WORDSET.format('text')} AS w FROM documents),
st AS (SELECT origin, w, min(ord) AS id FROM ws WHERE len(w) > 0 GROUP BY 1, 2),
tk AS (SELECT origin, id, len(w) AS m, unnest(w) AS t FROM st),
pr AS (SELECT a.origin, a.id AS a, b.id AS b, count(*) AS c, any_value(a.m) AS ma, any_value(b.m) AS mb FROM tk a JOIN tk b ON a.origin = b.origin AND a.t = b.t AND a.id < b.id GROUP BY 1, 2, 3),
eg AS (SELECT origin, a, b, c / CAST(ma + mb - c AS DOUBLE) AS s FROM pr WHERE c / CAST(ma + mb - c AS DOUBLE) >= {THETA})"""
# All nodes that a node reaches, by a recursion that keeps distinct pairs.
CLUSTERS = SETS + """,
lk AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg),
reach AS (SELECT a AS x, b AS y FROM lk UNION SELECT r.x, e.b FROM reach r JOIN lk e ON e.a = r.y),
root AS (SELECT x AS id, least(x, min(y)) AS cluster FROM reach GROUP BY 1),
cl AS (SELECT ws.ord, coalesce(r.cluster, st.id) AS cluster, ws.origin, ws.w FROM ws JOIN st ON st.origin = ws.origin AND st.w = ws.w LEFT JOIN root r ON r.id = st.id)"""


@query("j4_similarity_join", f"WITH {SETS} SELECT origin, a, b, round(s, 6) AS similarity FROM eg")
def j4(spark, sf):
    sets = token_rows(spark, sf).where(F.size("tokens") > 0).groupBy("origin", "tokens").agg(F.min("ord").alias("set_id"))
    return O.similar_sets(O.written(sets), THETA).withColumn("similarity", F.round("similarity", 6))


@query("j4_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT ord, cluster FROM cl")
def j4_clusters(spark, sf):
    return O.clusters(token_rows(spark, sf), THETA)


BURST = """
b1 AS (SELECT skill || '-' || CAST(user_id % 2 AS VARCHAR) AS cluster, skill, result, ts FROM ep UNION ALL SELECT 'tight', skill, 'success', TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(ord) FROM ep WHERE skill = 'skill_7'),
b2 AS (SELECT cluster, skill, result, count(*) AS n, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM b1 GROUP BY 1, 2, 3),
b3 AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, max(n) AS m, arg_max((skill, result), (n, skill, result)) AS top, (max(l) - min(f)) / 1e6 AS s FROM b2 GROUP BY 1)"""


@query("a13_bursts", views.with_views("ep", f"""WITH {BURST} SELECT cluster, n, (k = 1 OR m / n >= 0.75) AND (n > 150 OR (n > 20 AND s < 1800)) AS burst,
CASE WHEN (k = 1 OR m / n >= 0.75) AND n > 150 THEN CASE WHEN k > 1 THEN 'chronic_dominant' ELSE 'chronic_noise' END || ': n=' || CAST(n AS VARCHAR) || ' bucket=' || top[1] || '/' || top[2] || CASE WHEN k > 1 THEN ' frac=' || printf('%.2f', m / n) ELSE '' END
  WHEN (k = 1 OR m / n >= 0.75) AND n > 20 AND s < 1800 THEN CASE WHEN k > 1 THEN 'burst_dominant' ELSE 'burst' END || ': n=' || CAST(n AS VARCHAR) || ' window_s=' || CAST(CAST(floor(s) AS BIGINT) AS VARCHAR) || ' bucket=' || top[1] || '/' || top[2] || CASE WHEN k > 1 THEN ' frac=' || printf('%.2f', m / n) ELSE '' END ELSE '' END AS reason FROM b3"""))
def a13(spark, sf):
    """With thresholds that fit the table; the defaults are larger."""
    e = views.episodes(spark, sf)
    loose = e.select(F.concat("skill", F.lit("-"), (F.col("user_id") % 2).cast("string")).alias("cluster"), "skill", "result", "ts")
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("ord") * 1000).cast("timestamp_ntz")
    tight = e.where("skill = 'skill_7'").select(F.lit("tight").alias("cluster"), "skill", F.lit("success").alias("result"), at.alias("ts"))
    return O.bursts(loose.union(tight), 20, 1800, 150, 0.75)


# Episodes with text: documents, rated by their ids.
RATED = f"""
rt AS (SELECT cl.*, text AS claim, TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 20 AS INT)) AS ts, doc_id % 10 + 1 AS pain_score, doc_id % 7 + 3 AS importance FROM cl JOIN documents ON doc_id = cl.ord),
sl AS (SELECT *, round({SALIENCE}, 6) AS s FROM rt),
bs AS (SELECT cluster, count(*) AS n, arg_max(claim, (s, -ord)) AS claim, arg_max(origin, (s, -ord)) AS origin, max(s) AS s FROM sl GROUP BY 1),
sh AS (SELECT cluster, t, count(*) AS c FROM (SELECT cluster, unnest(w) AS t FROM sl) GROUP BY 1, 2),
cm AS (SELECT bs.cluster, list(t ORDER BY t) AS conditions, array_to_string(list(t ORDER BY length(t) DESC, t)[1:3], '_') AS top FROM bs JOIN sh ON sh.cluster = bs.cluster AND sh.c = bs.n GROUP BY 1),
pt AS (SELECT bs.cluster, bs.n, bs.s, bs.claim, bs.origin, top, substr(md5({CLAIM.format('bs.claim')} || '||' || array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(conditions, []), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') || '||origin=' || bs.origin), 1, 12) AS id FROM bs LEFT JOIN cm USING (cluster))"""


@query("a14_patterns", f"WITH RECURSIVE {CLUSTERS}, {RATED} SELECT cluster, id, 'pattern_' || coalesce(nullif(top, ''), 'untitled') || '_' || substr(id, 1, 6) AS name, n AS cluster_size, round(s * least(3, n), 6) AS canonical_salience FROM pt")
def a14(spark, sf):
    rows = token_rows(spark, sf)
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("claim"), (moment() - F.make_dt_interval((F.col("doc_id") % 20).cast("int"))).alias("ts"), (F.col("doc_id") % 10 + 1).alias("pain_score"), (F.col("doc_id") % 7 + 3).alias("importance"))
    return O.patterns(O.clustered(rows, THETA).join(d, "ord"), moment()).select("cluster", "id", "name", "cluster_size", "canonical_salience")


@query("u3_common_tokens", f"WITH ws AS (SELECT conv_id, {WORDSET.format('text')} AS w FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM ws GROUP BY 1) SELECT x.conv_id, t AS token FROM (SELECT conv_id, t, count(*) AS c FROM (SELECT conv_id, unnest(w) AS t FROM ws) GROUP BY 1, 2) x JOIN n ON n.conv_id = x.conv_id AND c = n")
def u3(spark, sf):
    """Tokens that all turns of a conversation share: those counted as often as there are turns."""
    d = views.table(spark, sf, "conversations").select("conv_id", text.word_set(F.col("text")).alias("w"))
    n = d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("conv_id", F.explode("w").alias("token")).groupBy("conv_id", "token").agg(F.count(F.lit(1)).alias("c")).join(n, "conv_id").where("c = n").select("conv_id", "token")


@query("u4_new_evidence", views.with_views("ep", "SELECT DISTINCT user_id, tokens_out FROM ep WHERE ts >= TIMESTAMP '2024-01-16' EXCEPT SELECT user_id, tokens_out FROM ep WHERE ts < TIMESTAMP '2024-01-16'"))
def u4(spark, sf):
    e = views.episodes(spark, sf)
    return e.where("ts >= timestamp_ntz'2024-01-16'").select("user_id", "tokens_out").subtract(e.where("ts < timestamp_ntz'2024-01-16'").select("user_id", "tokens_out"))


@query("u5_auto_clear", views.with_views("md", "SELECT path FROM md WHERE needs_review AND path NOT IN (SELECT path FROM md WHERE length(body) < 800)"))
def u5(spark, sf):
    d = views.memory_docs(spark, sf)
    return d.where("needs_review").select("path").subtract(d.where(F.length("body") < 800).select("path"))


@query("u6_ordered_dedupe", "SELECT min(doc_id) AS ord, md5(lower(trim(text))) AS h FROM documents GROUP BY 2")
def u6(spark, sf):
    return views.table(spark, sf, "documents").groupBy(F.md5(F.lower(F.trim("text"))).alias("h")).agg(F.min("doc_id").alias("ord")).select("ord", "h")


DIGEST = """
dg AS (SELECT conv_id AS ord, list_transform(regexp_extract_all(arg_min(text, turn), '[a-zA-Z]+'), lambda x: CASE WHEN length(x) % 2 = 0 THEN upper(x) ELSE ' ' || x END) AS tags, CASE WHEN count(*) >= 6 THEN 'long' ELSE 'short' END AS outcome FROM conversations GROUP BY 1)"""


def digests(spark, sf):
    c = views.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("ord")).agg(F.min_by("text", "turn").alias("t"), F.when(F.count(F.lit(1)) >= 6, "long").otherwise("short").alias("outcome"))
    tags = F.transform(F.regexp_extract_all("t", F.lit("[a-zA-Z]+"), F.lit(0)), lambda x: F.when(F.length(x) % 2 == 0, F.upper(x)).otherwise(F.concat(F.lit(" "), x)))
    return c.select("ord", tags.alias("tags"), "outcome")


TAGS = DIGEST + ", tg AS (SELECT tag, count(*) AS n, count(*) FILTER (outcome = 'long') AS n_long, min(ord) AS first FROM (SELECT ord, outcome, unnest(list_distinct(list_transform(tags, lambda x: lower(trim(x))))) AS tag FROM dg) GROUP BY 1 HAVING count(*) >= 3)"


@query("a15_themes", f"WITH {TAGS} SELECT * FROM tg")
def a15(spark, sf):
    return O.themes(digests(spark, sf))


@query("a16_theme_candidates", f"WITH {TAGS} SELECT substr(md5('theme:' || tag), 1, 12) AS id, 'Recurring theme: ' || tag AS claim, CAST(greatest(5, least(10, n)) AS BIGINT) AS salience FROM tg WHERE first % 2 = 0")
def a16(spark, sf):
    """Themes not yet decided, as candidates with ids of their own."""
    t = O.themes(digests(spark, sf))
    decided = t.where("first % 2 <> 0").select("tag")
    new = t.join(decided, "tag", "left_anti")
    return new.select(F.substring(F.md5(F.concat(F.lit("theme:"), "tag")), 1, 12).alias("id"), F.concat(F.lit("Recurring theme: "), "tag").alias("claim"), F.greatest(F.lit(5), F.least(F.lit(10), F.col("n"))).cast("long").alias("salience"))


@query("j7_exact_duplicates", f"SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND {CLAIM.format('text')} IN (SELECT {CLAIM.format('text')} FROM documents WHERE doc_id % 3 = 0)")
def j7(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.sha2(text.normalized_claim(F.col("text")), 256).alias("h"))
    return d.where("doc_id % 3 <> 0").join(d.where("doc_id % 3 = 0").select("h"), "h", "left_semi").select("doc_id")


PRIOR = """
fd AS (SELECT doc_id AS slug, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE source END AS claim, [CAST(doc_id % 5 AS VARCHAR), CAST(doc_id % 3 AS VARCHAR)] AS evidence FROM documents),
pr AS (SELECT doc_id AS slug, 'staged' AS place, NULL AS status, NULL AS snap, NULL AS blocked FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT doc_id, 'rejected', NULL, [CAST(doc_id % 5 AS VARCHAR), CAST(doc_id % 4 AS VARCHAR)], doc_id % 9 <> 0 FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'graduated', CASE WHEN doc_id % 6 = 0 THEN 'provisional' END, [CAST(doc_id % 5 AS VARCHAR)], NULL FROM documents WHERE doc_id % 3 = 0),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY CASE place WHEN 'staged' THEN 0 WHEN 'rejected' THEN 1 ELSE 2 END) AS rn FROM pr) WHERE rn = 1)"""


@query("j8_restage", f"""WITH {PRIOR} SELECT fd.slug, CASE WHEN trim(claim) = '' THEN 'skip_empty' WHEN place IS NULL THEN 'stage_new' WHEN place = 'graduated' AND coalesce(status, 'accepted') <> 'provisional' THEN 'skip_accepted'
  WHEN place IN ('rejected', 'graduated') AND len(list_filter(evidence, lambda x: NOT list_contains(coalesce(snap, []), x))) = 0 AND coalesce(blocked, true) THEN 'skip_unchanged' WHEN place IN ('rejected', 'graduated') THEN 'restage' ELSE 'restage_staged' END AS action
FROM fd LEFT JOIN p1 ON p1.slug = fd.slug""")
def j8(spark, sf):
    d = views.table(spark, sf, "documents")
    s = lambda n: (F.col("doc_id") % n).cast("string")
    found = d.select(F.col("doc_id").alias("slug"), F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("source")).alias("claim"), F.array(s(5), s(3)).alias("evidence"))
    none, strings = F.lit(None), "array<string>"
    prior = d.where("doc_id % 8 = 0").select(F.col("doc_id").alias("slug"), F.lit("staged").alias("place"), none.cast("string").alias("status"), none.cast(strings).alias("snapshot"), none.cast("boolean").alias("blocked"))
    prior = prior.union(d.where("doc_id % 4 = 0").select("doc_id", F.lit("rejected"), none.cast("string"), F.array(s(5), s(4)), F.col("doc_id") % 9 != 0))
    prior = prior.union(d.where("doc_id % 3 = 0").select("doc_id", F.lit("graduated"), F.when(F.col("doc_id") % 6 == 0, "provisional"), F.array(s(5)), none.cast("boolean")))
    return O.stage(found, prior)


@query("st13_decay", views.with_views("ep", f"SELECT ord, ts < TIMESTAMP '2024-04-15' - to_days(90) AND {SALIENCE.replace(AS_OF, '2024-04-15 00:00:00')} < 2.0 AS archived FROM ep"))
def st13(spark, sf):
    return O.decay(views.episodes(spark, sf), moment("2024-04-15 00:00:00")).select("ord", "archived")


NARRATED = "CASE action WHEN 'view' THEN 'Ran: view' WHEN 'click' THEN 'Edited a' ELSE 'Prefer small steps' END"


@query("st14_residue_sweep", views.with_views("ep", f"SELECT ord, CASE WHEN action IN ('view', 'click') THEN 'rejected' ELSE 'staged' END AS status FROM ep"))
def st14(spark, sf):
    claim = F.when(F.col("action") == "view", "Ran: view").when(F.col("action") == "click", "Edited a").otherwise("Prefer small steps")
    return views.episodes(spark, sf).select("ord", F.when(score.narration(claim) != "", "rejected").otherwise("staged").alias("status"))


@query("st15_lifecycle", views.with_views("ep", """SELECT id, coalesce(CASE last WHEN 'graduate' THEN 'graduated' WHEN 'reject' THEN 'rejected' WHEN 'demote' THEN 'demoted' WHEN 'reopen' THEN 'staged' END, 'staged') AS status, coalesce(n, 0) AS decisions, coalesce(r, 0) AS rejections FROM (SELECT DISTINCT user_id AS id FROM ep)
LEFT JOIN (SELECT user_id AS id, arg_max(a, ord) AS last, count(*) AS n, count(*) FILTER (a = 'reject') AS r FROM (SELECT *, CASE action WHEN 'signup' THEN 'graduate' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'demote' WHEN 'click' THEN 'reopen' END AS a FROM ep) WHERE a IS NOT NULL GROUP BY 1) USING (id)"""))
def st15(spark, sf):
    e = views.episodes(spark, sf)
    action = F.when(F.col("action") == "signup", "graduate").when(F.col("action") == "error", "reject").when(F.col("action") == "purchase", "demote").when(F.col("action") == "click", "reopen")
    return O.decide(e.select(F.col("user_id").alias("id")).distinct(), e.select(F.col("user_id").alias("id"), "ord", action.alias("action")).where("action is not null"))


@query("w5_lesson_dedupe", views.with_views("ep", "SELECT skill AS id, arg_max(action, ord) AS claim, min(ord) AS seen FROM ep GROUP BY 1"))
def w5(spark, sf):
    return views.episodes(spark, sf).groupBy(F.col("skill").alias("id")).agg(F.max_by("action", "ord").alias("claim"), F.min("ord").alias("seen"))


@query("w6_lesson_supersession", views.with_views("ep", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS lessons, count(*) FILTER (ord IN (SELECT ord - 1 FROM ep WHERE result = 'success' AND action = 'purchase')) AS superseded FROM ep GROUP BY 1"))
def w6(spark, sf):
    """A lesson is superseded only by an accepted one."""
    e = views.episodes(spark, sf)
    by = e.where("result = 'success' and action = 'purchase'").select((F.col("ord") - 1).alias("ord"), F.lit(1).alias("by"))
    return e.join(by, "ord", "left").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("lessons"), F.count("by").alias("superseded"))


CAND = f"ca AS (SELECT user_id AS id, count(*) AS size, max(round({SALIENCE}, 6)) AS s, min(ts) AS staged FROM ep GROUP BY 1)"


def candidates(spark, sf):
    s = F.round(score.salience(F.col("ts"), F.col("pain_score"), F.col("importance"), F.lit(1), moment()), 6)
    return views.episodes(spark, sf).groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("size"), F.max(s).alias("s"), F.min("ts").alias("staged"))


PRIORITY = f"round(greatest(1, size) * greatest(0.1, s) * (1.0 + least(1.0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(staged)) / 86400000000.0) / 14.0)), 6)"


@query("t4_candidate_list", views.with_views("ep", f"WITH {CAND} SELECT id, row_number() OVER (ORDER BY {PRIORITY} DESC, id) AS place FROM ca"))
def t4(spark, sf):
    p = F.round(score.priority(F.col("size"), F.col("s"), F.col("staged"), moment()), 6)
    return row_numbers(candidates(spark, sf).select("id", p.alias("p")), [-F.col("p"), "id"], "place").select("id", "place")


@query("t5_review_queue", views.with_views("ep", f"WITH {CAND} SELECT id, {PRIORITY} AS priority FROM ca ORDER BY priority DESC, id LIMIT 10"))
def t5(spark, sf):
    p = F.round(score.priority(F.col("size"), F.col("s"), F.col("staged"), moment()), 6)
    return candidates(spark, sf).select("id", p.alias("priority")).orderBy(F.desc("priority"), "id").limit(10)


@query("t6_pending_top", views.with_views("ep", f"WITH {CAND} SELECT id, size FROM ca WHERE id % 3 <> 0 ORDER BY size DESC, id LIMIT 5"))
def t6(spark, sf):
    claim = F.when(F.col("id") % 3 == 0, "Command failed: cd /tmp/x").otherwise("ok")
    return candidates(spark, sf).where(~score.noise(claim)).select("id", "size").orderBy(F.desc("size"), "id").limit(5)


@query("t7_triage_order", views.with_views("ep", f"WITH {CAND} SELECT id, row_number() OVER (ORDER BY round(size * s, 6) DESC, id) AS place FROM ca"))
def t7(spark, sf):
    rated = candidates(spark, sf).select("id", F.round(F.col("size") * F.col("s"), 6).alias("p"))
    return row_numbers(rated, [-F.col("p"), "id"], "place").select("id", "place")


@query("a19_pending_counts", views.with_views("ep", "SELECT origin AS namespace, count(*) FILTER (importance >= 6) AS pending, count(*) FILTER (importance < 6 AND result = 'failure') AS misplaced FROM ep GROUP BY 1"))
def a19(spark, sf):
    return views.episodes(spark, sf).groupBy(F.col("origin").alias("namespace")).agg(F.count_if(F.col("importance") >= 6).alias("pending"), F.count_if((F.col("importance") < 6) & (F.col("result") == "failure")).alias("misplaced"))


@query("a20_set_digest", "SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(0) || sha256(text) || chr(0), '' ORDER BY CAST(doc_id AS VARCHAR))) AS sha FROM documents GROUP BY 1")
def a20(spark, sf):
    """A digest of a set of files: names and hashes, sorted by name, hashed as they stream by."""
    d = views.table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha"))
    step = lambda state, row, out: state[1].update(f"{row.name}\0{row.sha}\0".encode())
    return fold(d, ["source"], ["name"], "source string, sha string", lambda key: (key[0], hashlib.sha256()), step, lambda state, out: out.append((state[0], state[1].hexdigest())))


@query("graph_components", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - 1 AS b FROM part WHERE p_partkey % 9 <> 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS x, b AS y FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y) SELECT x AS node, least(x, min(y)) AS root FROM r GROUP BY 1 HAVING least(x, min(y)) <> x")
def graph(spark, sf):
    """Chains of nine parts, each linked to the one before."""
    p = views.table(spark, sf, "part")
    return components(p.where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 1).alias("b")))
