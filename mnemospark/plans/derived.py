"""Queries of classifiers, paths, notes and numbers over rows made of the tables' columns.

A row's text is made of its columns by one expression that Spark and DuckDB both read; what it should come to
is worked out in DuckDB's own terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import views
from ..functions import report, score, text
from ..operators import extract, lint, redact
from ..session import AS_OF, moment
from ..sources import jsonl, markdown
from .registry import query
from .report import PHASE, SLUG

ID, EVENT, NL = "CAST(doc_id AS STRING)", "CAST(event_id AS STRING)", "chr(10)"


class Made:
    """Rows of a table with columns made by expressions of both engines."""

    def __init__(self, table: str, **columns: str):
        self.table, self.columns = table, columns

    def rows(self, spark: SparkSession, sf: str) -> DataFrame:
        return views.table(spark, sf, self.table).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.table})"


def case(on: str, *values: str) -> str:
    """One value for each remainder, the last for all others."""
    return f"CASE {on} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


# --- lines, files, notes

_LINE = "'{\"schema_version\": \"1.1\", \"event\": \"' || event_type || '\"'"
STRICT = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("event", T.StringType()), T.StructField("ts_ms", T.LongType())])
LINES = Made("events", ord="event_id", line=case(
    "event_id % 7", f"{_LINE} || ', \"ts_ms\": ' || {EVENT} || '}}'", f"replace({_LINE}, '1.1', '1.0') || ', \"ts_ms\": 5}}'", f"{_LINE} || '}}'", f"{_LINE} || ', \"ts_ms\": 5, \"extra\": ' || {EVENT} || '}}'",
    f"{_LINE} || ', \"ts_ms\": 5, \"x_note\": \"' || repeat('a', CAST(1000 + event_id % 50 AS INT)) || '\"}}'", "event_type", f"{_LINE} || ', \"ts_ms\": 5, \"x_note\": \"ok\"}}'").replace("}}", "}"))


@query("sc4_strict_events", "SELECT event_id AS ord, CASE event_id % 7 WHEN 1 THEN 'version:1.0' WHEN 2 THEN 'missing:ts_ms' WHEN 3 THEN 'unknown:extra' WHEN 4 THEN CASE WHEN 1000 + event_id % 50 > 1024 THEN 'large:x_note' END WHEN 5 THEN 'malformed' END AS problem FROM events")
def sc4(spark, sf):
    return jsonl.strict(LINES.rows(spark, sf), STRICT, ["schema_version", "event", "ts_ms"], "1.1").select("ord", "problem")


LOGS = Made("documents", path=case("doc_id % 4", f"'log-' || {ID} || '.jsonl'", f"'snapshots/log-' || {ID} || '.jsonl'", f"source || '/log-' || {ID} || '.jsonl'"))


@query("sc5_namespace_paths", f"WITH p AS {LOGS.sql} SELECT path, 'default' AS namespace FROM p WHERE path NOT LIKE 'snapshots/%' UNION ALL SELECT path, split_part(path, '/', 1) FROM p WHERE contains(path, '/') AND path NOT LIKE 'snapshots/%'")
def sc5(spark, sf):
    """The default namespace reads the top file and those of all namespaces but snapshots; others read their own."""
    p = LOGS.rows(spark, sf).withColumn("own", F.regexp_extract("path", "^([^/]+)/", 1)).where("own <> 'snapshots'")
    return p.select("path", F.explode(F.array_distinct(F.array(F.lit("default"), F.when(F.col("own") == "", "default").otherwise(F.col("own"))))).alias("namespace"))


NOTES = Made("documents", doc_id="doc_id", body="text", path=case("doc_id % 5", f"source || '/n' || {ID} || '.md'", f"'archive/' || {ID} || '.md'", f"'m' || {ID} || '.txt'", f"'m' || {ID} || '.md'"), text=case(
    "doc_id % 3", f"'---' || {NL} || 'name: Note ' || {ID} || {NL} || 'type: feedback' || {NL} || '---' || {NL} || text", f"'# Head ' || {ID} || {NL} || text", "text"))
SOME_NOTES = f"(SELECT * FROM {NOTES.sql} WHERE doc_id % 5 NOT IN (1, 2) AND trim(text) <> '')"


def notes(spark, sf):
    rows = NOTES.rows(spark, sf)
    return rows.where(F.col("path").rlike(score.glob_pattern("**/*.md")) & ~score.excluded(F.col("path"), ["archive/**"]) & (F.trim("text") != ""))


@query("sc6_markdown_scan", f"""SELECT path, CASE doc_id % 3 WHEN 0 THEN 'Note ' || doc_id WHEN 1 THEN 'Head ' || doc_id ELSE coalesce(nullif(regexp_extract(text, '(?m)^#\\s+(.+?)\\s*$', 1), ''), CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE 'm' END || doc_id) END AS title FROM {SOME_NOTES}""")
def sc6(spark, sf):
    return markdown.parsed(notes(spark, sf)).select("path", markdown.title(F.col("frontmatter"), F.col("text"), F.col("path")).alias("title"))


@query("sc9_frontmatter", f"""SELECT path, CASE WHEN doc_id % 3 = 0 THEN '{{"name":"Note ' || doc_id || '","type":"feedback"}}' ELSE '{{}}' END AS frontmatter, md5(CASE WHEN doc_id % 3 = 0 THEN body ELSE text END) AS body FROM {SOME_NOTES}""")
def sc9(spark, sf):
    out = markdown.parsed(notes(spark, sf).drop("body"))
    return out.select("path", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("frontmatter")))).alias("frontmatter"), F.md5("body").alias("body"))


@query("sc10_simple_frontmatter", f"""SELECT path, CASE WHEN doc_id % 3 = 0 THEN '{{"name":["Note ' || doc_id || '"],"type":["feedback"]}}' ELSE '{{}}' END AS front FROM {SOME_NOTES}""")
def sc10(spark, sf):
    front = markdown.parse_simple(markdown.block(F.col("text")))
    return notes(spark, sf).select("path", front.alias("front")).select("path", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("front")))).alias("front"))


PATHS = Made("documents", path=case("doc_id % 7", f"'a' || {ID} || '.md'", f"'d/' || source || '.md'", f"'d/e/b' || {ID} || '.md'", f"'d/e/x' || {ID} || '.txt'", f"'node_modules/p' || {ID} || '.md'", f"'archive/old/z' || {ID} || '.md'", "'archive'"))


@query("sc7_globs", f"SELECT path, regexp_matches(path, '^(?:.*/)?[^/]*\\.md$') AS any_md, regexp_matches(path, '^[^/]*\\.md$') AS top_md, regexp_matches(path, '^d/.*$') AS below_d FROM {PATHS.sql}")
def sc7(spark, sf):
    return PATHS.rows(spark, sf).select("path", *[F.col("path").rlike(score.glob_pattern(g)).alias(n) for n, g in (("any_md", "**/*.md"), ("top_md", "*.md"), ("below_d", "d/**"))])


@query("sc8_excludes", f"SELECT path, starts_with(path, 'archive/') OR path = 'archive' OR starts_with(path, 'node_modules/') OR path LIKE '%.txt' AS excluded FROM {PATHS.sql}")
def sc8(spark, sf):
    return PATHS.rows(spark, sf).select("path", score.excluded(F.col("path"), ["archive/**", "node_modules/**", "*.txt"]).alias("excluded"))


_SECOND = "CAST(floor(doc_id / 11) AS BIGINT) % 2 = 0"
LISTING = Made("documents", source="lang || '-' || CAST(doc_id % 11 AS STRING)", path=case(
    "doc_id % 11", f"CASE WHEN {_SECOND} THEN 'MEMORY.md' ELSE 'voice' || {ID} || '.md' END", f"CASE WHEN {_SECOND} THEN 'personal/notes/x' || {ID} || '.md' ELSE 'feedback_' || {ID} || '.md' END", f"'semantic/lessons/l' || {ID} || '.md'", f"'x' || {ID} || '.plan.md'",
    f"'sessions/2024/01/02/rollout-' || {ID} || '.jsonl'", f"CASE WHEN {_SECOND} THEN 'history.jsonl' ELSE 'config.toml' END", f"'readme' || {ID} || '.md'", f"'data' || {ID} || '.bin'", f"'.cursorrules'", f"CASE WHEN {_SECOND} THEN 'MEMORY.md' ELSE 'x' || {ID} || '.plan.md' END", f"'user_me' || {ID} || '.md'"))


@query("sc16_format_detection", f"""WITH s AS (SELECT source, count(*) AS n, bool_or(path = '.cursorrules') AS rules, bool_or(starts_with(path, 'sessions/') AND contains(path, 'rollout-')) OR (bool_or(path = 'history.jsonl') AND bool_or(path = 'config.toml')) AS codex,
  bool_or(path LIKE '%.plan.md' AND NOT contains(path, '/')) AS plans, bool_or(path = 'MEMORY.md') AS idx, bool_or(regexp_matches(path, '^(feedback_|user_|project_|cycle-|cycle_|reference_)[^/]*\\.md$')) AS prefixed,
  bool_or(path LIKE '%.md' AND NOT contains(path, '/') AND path <> 'MEMORY.md') AS bare, bool_or(starts_with(path, 'personal/') OR starts_with(path, 'semantic/')) AS dirs, bool_or(regexp_matches(path, '^(personal/(profile|notes|references)|semantic/lessons)/')) AS nested, bool_or(path LIKE '%.md' OR path LIKE '%.jsonl') AS known
  FROM {LISTING.sql} GROUP BY 1)
SELECT source, CASE WHEN rules AND n = 1 THEN 'cursor-rules' WHEN codex THEN 'codex-cli' WHEN plans AND NOT (idx OR prefixed OR dirs) THEN 'cursor-plans' WHEN nested THEN CASE WHEN prefixed OR (idx AND bare) THEN 'claude-code-mixed' ELSE 'claude-code-nested' END
  WHEN prefixed OR (idx AND bare) THEN 'claude-code-flat' WHEN known THEN 'unknown' ELSE 'empty' END AS format FROM s""")
def sc16(spark, sf):
    return markdown.detect_format(LISTING.rows(spark, sf))


FILES = Made("documents", name=case("doc_id % 8", "'MEMORY.md'", f"'feedback_' || {ID} || '.md'", f"'user_' || source || '.md'", f"'project_' || {ID} || '.md'", f"'cycle-' || {ID} || '.md'", f"'cycle_' || {ID} || '.md'", f"'reference_' || lang || '.md'", f"source || '_user_.md'"))


@query("sc19_routing", f"SELECT name, CASE WHEN name = 'MEMORY.md' THEN 'index' WHEN regexp_matches(name, '^(feedback|user|project|reference)_') THEN split_part(name, '_', 1) WHEN regexp_matches(name, '^cycle[-_]') THEN 'cycle' ELSE 'misc' END AS route FROM {FILES.sql}")
def sc19(spark, sf):
    return FILES.rows(spark, sf).select("name", markdown.categorize(F.col("name")).alias("route"))


FEEDBACK = Made("documents", ord="doc_id", t="'Use ' || source || '.' || " + case(
    "doc_id % 3", f"{NL} || {NL} || '**Why:** ' || lang || {NL} || {NL} || '**How to apply:** in ' || {ID}", "''", f"{NL} || 'How to apply: always ' || {ID} || {NL} || 'Why: because ' || lang"))


@query("sc20_feedback", "SELECT doc_id AS ord, 'Use ' || source || '.' AS claim, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '' ELSE 'because ' || lang END AS why, CASE doc_id % 3 WHEN 0 THEN 'in ' || doc_id WHEN 1 THEN '' ELSE 'always ' || doc_id END AS how FROM documents")
def sc20(spark, sf):
    out = FEEDBACK.rows(spark, sf).select("ord", markdown.feedback(F.col("t")).alias("f"))
    strip = lambda c: F.btrim(F.col(c), F.lit(" \n"))
    return out.select("ord", *[strip(f"f.{c}").alias(c) for c in ("claim", "why", "how")])


INDEX = Made("documents", line=case("doc_id % 4", f"'- [Title](notes/n' || {ID} || '.md) — hook of ' || source", "'- [No hook](x.md)'", f"'  - [B](b-' || {ID} || '.md) - other ' || lang || ' '", "'plain ' || source"))


@query("sc21_index_lines", "SELECT CASE doc_id % 4 WHEN 0 THEN 'n' ELSE 'b-' END || doc_id AS stem, CASE doc_id % 4 WHEN 0 THEN 'hook of ' || source ELSE 'other ' || lang END AS hook FROM documents WHERE doc_id % 4 IN (0, 2)")
def sc21(spark, sf):
    return INDEX.rows(spark, sf).select(markdown.index_hooks(F.col("line")).alias("h")).where("h is not null").select("h.stem", "h.hook")


# --- predicates

SINCE = Made("events", ord="event_id", since=case("event_id % 5", *[f"CAST(user_id % 60 + 1 AS STRING) || '{u}'" for u in "dhms"], "CAST(CAST(ts AS DATE) AS STRING)"))


@query("pf4_since", f"SELECT event_id AS ord, CASE WHEN event_id % 5 < 4 THEN epoch_ms(TIMESTAMP '{AS_OF}') - (user_id % 60 + 1) * [86400000, 3600000, 60000, 1000][event_id % 5 + 1] ELSE epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) END AS ms FROM events")
def pf4(spark, sf):
    unit = F.create_map(*[F.lit(x) for kv in {"d": 86400, "h": 3600, "m": 60, "s": 1}.items() for x in kv])
    n, u = F.regexp_extract("since", r"^(\d+)([dhms])$", 1), F.regexp_extract("since", r"^(\d+)([dhms])$", 2)
    now = F.unix_millis(moment().cast("timestamp"))
    return SINCE.rows(spark, sf).select("ord", F.when(n != "", now - n.try_cast("long") * F.try_element_at(unit, u) * 1000).otherwise(F.unix_millis(F.try_to_timestamp("since"))).alias("ms"))


REQUESTS = Made("events", ord="event_id", request=case("event_id % 5", "'show the last ' || CAST(user_id % 120 AS STRING) || ' days by hour'", "'weekly trend for this quarter'", "'past ' || CAST(user_id % 50 AS STRING) || ' days monthly'", "'everything of ' || event_type", "'Today by week'"))


@query("pf5_natural_window", f"""SELECT ord, CASE WHEN days <= 7 THEN '7d' WHEN days <= 30 THEN '30d' WHEN days <= 90 THEN '90d' ELSE 'all' END AS win, bucket FROM (
  SELECT ord, CASE ord % 5 WHEN 0 THEN n WHEN 1 THEN 90 WHEN 2 THEN n WHEN 4 THEN 1 END AS days, ['hour', 'week', 'month', 'day', 'week'][ord % 5 + 1] AS bucket FROM (SELECT ord, TRY_CAST(regexp_extract(request, '[0-9]+') AS INT) AS n FROM {REQUESTS.sql}))""")
def pf5(spark, sf):
    low = F.lower("request")
    days = F.regexp_extract(low, r"(\d+)\s*days?", 1).try_cast("int")
    days = F.when(days.isNotNull(), days).when(low.rlike("today|yesterday"), 1).when(low.rlike(r"\bweek\b"), 7).when(low.rlike(r"\bmonth\b"), 30).when(low.rlike("quarter"), 90)
    window = F.when(days <= 7, "7d").when(days <= 30, "30d").when(days <= 90, "90d").otherwise("all")
    bucket = F.when(low.rlike("hour"), "hour").when(low.rlike("weekly|by week"), "week").when(low.rlike("monthly|by month"), "month").otherwise("day")
    return REQUESTS.rows(spark, sf).select("ord", window.alias("win"), bucket.alias("bucket"))


SAID = Made("conversations", conv_id="conv_id", turn="turn", claim=case("(conv_id + turn) % 9", "'Edited ' || text", "'Wrote a.md (3 lines) ' || text", "'Ran: ' || text", "'FAILURE in x-y: ' || text", "text", "'High-stakes op FAILED (secret): ' || text", "' Command failed: ' || text", "'Tool Bash completed successfully'", "NULL"))
NARR = score.NARRATION.replace("'", "''")


@query("pf10_narration", f"SELECT conv_id, turn, CASE WHEN regexp_matches(trim(coalesce(claim, '')), '{NARR}') THEN 'activity_log:' || regexp_replace(lower(split_part(regexp_replace(trim(claim), '\\s+', ' ', 'g'), ' ', 1)), ':+$', '') ELSE '' END AS reason FROM {SAID.sql}")
def pf10(spark, sf):
    return SAID.rows(spark, sf).select("conv_id", "turn", score.narration(F.col("claim")).alias("reason"))


EVIDENCE = Made("documents", ord="doc_id", claim=case("doc_id % 6", "'use /tmp/' || source", "'Detected potential secret in ' || lang", "'fine'"), paths=case("doc_id % 5", f"'/a/-sandbox-/' || {ID} || '|/x-test/y|2024'", f"'/a/b|/x-test/' || {ID}", f"'2024|' || {ID}", "''", "NULL"))
_NOISY = lambda c: "(" + " OR ".join(f"contains({c}, '{m}')" for m in score.NOISE) + ")"


@query("pf11_noise", f"""SELECT ord, {_NOISY('claim')} OR (len(p) > 0 AND len(list_filter(p, lambda x: NOT {_NOISY('x')})) = 0) AS noise FROM (SELECT ord, claim, list_filter(string_split(coalesce(paths, ''), '|'), lambda x: contains(x, '/')) AS p FROM {EVIDENCE.sql})""")
def pf11(spark, sf):
    paths = F.filter(F.split(F.coalesce("paths", F.lit("")), r"\|"), lambda e: e.contains("/"))
    return EVIDENCE.rows(spark, sf).select("ord", (score.noise(F.col("claim")) | ((F.size(paths) > 0) & F.forall(paths, lambda p: score.noise(p)))).alias("noise"))


REVIEW = Made("documents", ord="doc_id", v=case("doc_id % 6", "'true'", "' YES '", "'no'", "NULL", "NULL", "'1'"), raw=case("doc_id % 6", "text", "text", "text", f"'---' || {NL} || 'needs_review: true' || {NL} || 'bad: : x' || {NL} || '---' || {NL} || text", f"'---' || {NL} || 'a: 1' || {NL} || '---' || {NL} || 'needs_review: true' || {NL} || text", "text"))


@query("pf14_needs_review", f"SELECT ord, CASE WHEN v IS NOT NULL THEN lower(trim(v)) IN ('true', 'yes', '1') ELSE contains(split_part(raw, chr(10) || '---', 1), 'needs_review: true') END AS flagged FROM {REVIEW.sql}")
def pf14(spark, sf):
    block = F.regexp_extract("raw", r"(?s)^(---.*?)\n---", 1)
    flag = F.when(F.col("v").isNotNull(), F.lower(F.trim("v")).isin("true", "yes", "1")).otherwise(block.rlike(r"(?im)^needs_review:\s*[\"']?(true|yes|1)[\"']?\s*$"))
    return REVIEW.rows(spark, sf).select("ord", flag.alias("flagged"))


PHRASES = Made("events", ord="event_id", action=case("user_id % 9", "'design the api'", "'audit'", "'run tests'", "'deploy'", "'Investigate crash'", "'learn'", "''", "event_type"), skill=case("event_id % 5", "'writer'", "'security'", "'Free Talk! ' || event_type", "''", "'ops'"))


@query("pf18_phase_workflow", f"SELECT ord, {PHASE} AS phase, CASE WHEN ({PHASE}) <> 'analysis' THEN ({PHASE}) ELSE {SLUG.format('''coalesce(nullif(skill, ''), action)''', 'analysis')} END AS workflow FROM {PHRASES.sql}")
def pf18(spark, sf):
    return PHRASES.rows(spark, sf).select("ord", report.phase(F.col("action"), F.col("skill")).alias("phase"), report.workflow(F.col("action"), F.col("skill")).alias("workflow"))


TOOLS = Made("conversations", conv_id="conv_id", turn="turn", tool=case("turn % 4", "'Bash'", "'Edit'", "'Write'", "'Read'"), args=case("conv_id % 5", "'deploy to production ' || text", "'src/config.py'", "'run the TEST'", "text"), ok="conv_id % 3 <> 0")
IMPORTANCE = f"CASE WHEN regexp_matches(args, '{score.HIGH}') THEN 9 WHEN regexp_matches(args, '{score.MEDIUM}') THEN 6 WHEN tool IN ('Edit', 'MultiEdit', 'Write') THEN 5 ELSE 3 END"


@query("pf21_importance", f"SELECT conv_id, turn, CAST({IMPORTANCE} AS BIGINT) AS importance FROM {TOOLS.sql}")
def pf21(spark, sf):
    return TOOLS.rows(spark, sf).select("conv_id", "turn", score.importance(F.col("tool"), F.col("args")).alias("importance"))


@query("pf22_pain", f"SELECT conv_id, turn, CAST(CASE WHEN NOT ok THEN CASE WHEN i < 9 THEN 8 ELSE 10 END WHEN i >= 8 THEN 5 WHEN i >= 6 THEN 3 ELSE 2 END AS BIGINT) AS pain FROM (SELECT *, {IMPORTANCE} AS i FROM {TOOLS.sql})")
def pf22(spark, sf):
    return TOOLS.rows(spark, sf).select("conv_id", "turn", score.pain(score.importance(F.col("tool"), F.col("args")), F.col("ok")).alias("pain"))


RUNS = Made(
    "events", ord="event_id", tool=case("event_id % 3", "'Read'", "'Bash'"), command=case("user_id % 5", "'make || true'", "'make ' || event_type", "'echo ''|| true'''", "'x; true '", "'grep Error log'"),
    is_error="CASE WHEN event_id % 13 = 0 THEN true WHEN event_id % 13 < 7 THEN false END", interrupted="CASE WHEN event_id % 17 = 0 THEN true WHEN event_id % 17 < 9 THEN false END",
    stderr=case("event_id % 5", "'build failed'", "'permission denied for the user on this host'", "''", "NULL", "'a warning of no weight, but of more than thirty characters'"), exit_code=case("user_id % 4", "0", "2", "NULL"),
    output=case("event_id % 7", f"'Error: no such file' || {NL} || 'more'", f"'all fine' || {NL} || 'error later'", "NULL", "''", "'fine ' || event_type"),
)
_BAD = lambda c: f"regexp_matches({c}, '{score.ERROR}')"


@query("pf23_success", f"""SELECT ord, CASE WHEN coalesce(is_error, false) THEN false WHEN tool = 'Bash' AND (coalesce(interrupted, false) OR (masked AND {_BAD('err')}) OR (NOT masked AND length(err) > 30 AND {_BAD('err')})) THEN false WHEN tool = 'Bash' AND exit_code IS NOT NULL THEN exit_code = 0
  ELSE NOT ({_BAD('substr(out, 1, 200)')} AND {_BAD("split_part(trim(out), chr(10), 1)")}) END AS ok FROM (SELECT *, coalesce(stderr, '') AS err, coalesce(output, '') AS out, regexp_matches(regexp_replace(command, '''[^'']*''', '', 'g'), '(?i)\\|\\|\\s*(true|:|exit\\s+0)|;\\s*(true|:)\\s*$') AS masked FROM {RUNS.sql})""")
def pf23(spark, sf):
    return RUNS.rows(spark, sf).select("ord", score.succeeded(*map(F.col, ("tool", "command", "is_error", "interrupted", "stderr", "exit_code", "output"))).alias("ok"))


DIGESTS = Made("documents", ord="doc_id", outcome=case("doc_id % 4", "'Shipped ' || lang", "'blocked by ' || source", "'PARTIAL'", "'odd ' || lang"), salience="CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 17 - 2 AS INT) END", tags=case("doc_id % 3", "''", "lang || ', ' || source", "NULL"))


@query("pf25_digest", f"SELECT ord, CASE WHEN contains(lower(outcome), 'shipped') THEN 'shipped' WHEN contains(lower(outcome), 'blocked') THEN 'blocked' WHEN contains(lower(outcome), 'partial') THEN 'partial' ELSE 'unknown' END AS outcome, CAST(greatest(1, least(10, coalesce(salience, 5))) AS BIGINT) AS salience, CAST(CASE WHEN coalesce(tags, '') = '' THEN 0 ELSE len(string_split(tags, ', ')) END AS BIGINT) AS n_tags FROM {DIGESTS.sql}")
def pf25(spark, sf):
    low = F.lower("outcome")
    kind = F.when(low.contains("shipped"), "shipped").when(low.contains("blocked"), "blocked").when(low.contains("partial"), "partial").otherwise("unknown")
    n = F.when(F.coalesce("tags", F.lit("")) == "", 0).otherwise(F.size(F.split("tags", ", ")))
    return DIGESTS.rows(spark, sf).select("ord", kind.alias("outcome"), F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("salience", F.lit(5)))).cast("long").alias("salience"), n.cast("long").alias("n_tags"))


STAMPS = Made(
    "events", ord="event_id", day="CAST(ts AS DATE)", ts="CASE WHEN event_id % 8 = 5 THEN CAST(CAST(ts AS DATE) AS STRING) || 'T00:00:00+02:00' END",
    v=case("event_id % 8", f"CAST(1700000000 + event_id AS STRING)", "CAST((1700000000 + event_id) * 1000 AS STRING)", "CAST((1700000000 + event_id) * 1000000 AS STRING)", "CAST(CAST(ts AS DATE) AS STRING) || 'T03:04:05Z'", "CAST(CAST(ts AS DATE) AS STRING)", "'soon'", "NULL", f"'-' || {EVENT} || '.5'"),
)


@query("pf27_epoch", f"""SELECT ord, CAST(CASE ord % 8 WHEN 0 THEN 1700000000 + ord WHEN 1 THEN 1700000000 + ord WHEN 2 THEN 1700000000 + ord WHEN 3 THEN epoch(day) + 11045 WHEN 4 THEN epoch(day) WHEN 5 THEN epoch(day) - 7200 END AS DOUBLE) AS epoch,
  ['float-epoch-s', 'float-epoch-ms', 'float-epoch-us', 'iso', 'iso', 'kernel-ts', NULL, NULL][ord % 8 + 1] AS label FROM {STAMPS.sql}""")
def pf27(spark, sf):
    rows = STAMPS.rows(spark, sf).withColumn("e", score.epoch_of(F.col("v"), F.col("ts")))
    return rows.select("ord", "e.epoch", "e.label")


NAMESPACES = Made("documents", namespace=case("doc_id % 7", "source", "'team-' || lang", "upper(lang)", f"{ID} || 'x'", "repeat('a', CAST(28 + doc_id % 9 AS INT))", "'snapshots'", f"'x_' || {ID}"))
RESERVED = ["snapshots", "candidates", "archive"]


@query("pf28_namespaces", f"SELECT namespace, regexp_full_match(namespace, '[a-z][a-z0-9_-]*') AND length(namespace) <= 32 AND namespace NOT IN ('snapshots', 'candidates', 'archive') AS valid FROM {NAMESPACES.sql}")
def pf28(spark, sf):
    n = F.col("namespace")
    return NAMESPACES.rows(spark, sf).select("namespace", (n.rlike("^[a-z][a-z0-9_-]{0,31}$") & ~n.isin(RESERVED)).alias("valid"))


# --- scalars

CONDITIONS = Made("documents", ord="doc_id", c=case("doc_id % 5", "' ' || upper(source) || ' '", "lang || '​' || source", "'Cross-' || lang || '  ' || source", f"lang || ' ' || chr(9) || {NL} || source", "'﻿Über ' || text"))


@query("f10_canonical_condition", f"SELECT ord, md5(lower(trim(regexp_replace(regexp_replace(c, '[​‌‍⁠﻿]', '', 'g'), '[\\s ]+', ' ', 'g')))) AS condition FROM {CONDITIONS.sql}")
def f10(spark, sf):
    return CONDITIONS.rows(spark, sf).select("ord", F.md5(text.canonical_condition(F.col("c"))).alias("condition"))


USER_PATTERNS = Made("documents", pattern=case("doc_id % 6", "'(' || lang || '+)+'", "'(' || source || '*)*y'", "'ab{2,}' || lang", "'(' || lang || ')+'", "'([0-9]+){' || CAST(doc_id % 4 AS STRING) || ',}'", "source || '.*'"))


@query("f22_pattern_guard", f"SELECT pattern, pattern LIKE '(%' AND (contains(pattern, '+)+') OR contains(pattern, '*)*') OR contains(pattern, '+){{')) AS dangerous FROM {USER_PATTERNS.sql}")
def f22(spark, sf):
    return USER_PATTERNS.rows(spark, sf).select("pattern", redact.dangerous(F.col("pattern")).alias("dangerous"))


UNTRUSTED = Made("conversations", conv_id="conv_id", turn="turn", t=case(
    "(conv_id + turn) % 6", "'a' || chr(13) || chr(10) || 'b' || chr(27) || '[31m' || text || chr(27) || '[0m'", "'x <System-Reminder a=1> ' || text || ' </ system-reminder>'", "'<!-- /runtime-reinject --> ' || text", "'[RECALL-doc-' || CAST(turn AS STRING) || '-START] ' || text || ' [recall-doc-3-end]'", "'bell' || chr(7) || ' tab' || chr(9) || text", "text"))


def sanitized(col):
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), "\x1b\\[[0-?]*[ -/]*[@-~]", ""), "\x1b", ""), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    out = F.regexp_replace(out, r"(?i)<\s*/?\s*system-reminder\b[^>]*>", "[blocked-tag:system-reminder]")
    out = F.regexp_replace(out, r"(?i)<!--\s*(/?)\s*runtime-reinject\s*-->", "[blocked-marker:$1runtime-reinject]")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\[recall-doc-(\d+)-start\]", "[blocked-fence:recall-doc-$1-start]"), r"(?i)\[recall-doc-(\d+)-end\]", "[blocked-fence:recall-doc-$1-end]")


def sanitize(col, size):
    """Control characters go, wrapper marks are made inert, the text is cut, and marks cut into shape are made inert again."""
    return F.substring(sanitized(F.substring(sanitized(col), 1, size)), 1, size)


def _clean(e):
    for pattern, put in (("\\x1b\\[[0-?]*[ -/]*[@-~]", ""), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), ("(?i)<\\s*/?\\s*system-reminder\\b[^>]*>", "[blocked-tag:system-reminder]"), ("(?i)<!--\\s*(/?)\\s*runtime-reinject\\s*-->", "[blocked-marker:\\1runtime-reinject]"), ("(?i)\\[recall-doc-(\\d+)-(start|end)\\]", "[blocked-fence:recall-doc-\\1-\\2]")):
        e = f"regexp_replace({e}, '{pattern}', '{put}', 'g')"
    return e if "lower" in e else e


_SAFE = _clean("replace(t, chr(13) || chr(10), chr(10))")


@query("f24_sanitize", f"SELECT conv_id, turn, substr({_clean('cut')}, 1, 200) AS safe FROM (SELECT conv_id, turn, substr(regexp_replace(regexp_replace({_SAFE}, '(recall-doc-\\d+-)(?i:START)\\]', '\\1start]', 'g'), '(recall-doc-\\d+-)(?i:END)\\]', '\\1end]', 'g'), 1, 200) AS cut FROM {UNTRUSTED.sql})")
def f24(spark, sf):
    return UNTRUSTED.rows(spark, sf).select("conv_id", "turn", sanitize(F.col("t"), 200).alias("safe"))


ORIGINS = Made("orders", ord="o_orderkey", a=case("o_orderkey % 4", "o_orderpriority", "NULL", "''"), b=case("o_orderkey % 3", "'import'", "NULL", "o_orderstatus"), c=case("o_custkey % 3", "'bob ' || o_orderstatus", "NULL", "''"), d=case("o_custkey % 4", "NULL", "''", "CAST(o_orderdate AS STRING)"))


@query("f25_provenance", f"""SELECT ord, CASE WHEN l = '' THEN 'none' ELSE l END AS label FROM (
  SELECT ord, concat_ws(', ', coalesce(nullif(a, ''), nullif(b, '')), 'reviewed-by=' || nullif(c, ''), substr(nullif(d, ''), 1, 10)) AS l FROM {ORIGINS.sql})""")
def f25(spark, sf):
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    label = F.concat_ws(", ", F.coalesce(some("a"), some("b")), F.concat(F.lit("reviewed-by="), some("c")), F.substring(some("d"), 1, 10))
    return ORIGINS.rows(spark, sf).select("ord", F.when(label == "", "none").otherwise(label).alias("label"))


TITLES = Made("documents", ord="doc_id", v=case("doc_id % 5", "'  My  ' || source || '!! ' || lang || ' '", "'Ünïcode-Ça ' || lang", "'***'", "source || '_b-c'", "text"))


@query("f27_slugs", f"""SELECT ord, CASE WHEN s = '' THEN 'unknown' ELSE substr(s, 1, 80) END AS slug, regexp_replace(substr(trim(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-+$', '') AS dashed FROM (
  SELECT ord, v, trim(regexp_replace(lower(trim(v)), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS s FROM {TITLES.sql})""")
def f27(spark, sf):
    return TITLES.rows(spark, sf).select("ord", text.slug(F.col("v")).alias("slug"), text.dashed_slug(F.col("v")).alias("dashed"))


NUMBERS = Made("events", ord="event_id", v=case("event_id % 7", f"{EVENT} || '.5'", "''", "event_type", f"'-' || {EVENT}", "'1e' || CAST(user_id % 5 AS STRING)", "NULL", f"' ' || {EVENT} || '.25'"))


@query("f29_safe_numbers", f"SELECT ord, TRY_CAST(v AS DOUBLE) AS num, CAST(round_even(TRY_CAST(v AS DOUBLE), 0) AS BIGINT) AS whole FROM {NUMBERS.sql}")
def f29(spark, sf):
    number = F.nullif(F.col("v").try_cast("double"), F.lit(float("nan")))
    return NUMBERS.rows(spark, sf).select("ord", number.alias("num"), F.bround(number).cast("long").alias("whole"))


VALUES = Made("events", ord="event_id", v=case("event_id % 6", "CAST((event_id + 1) * 1000000 + 200000 AS DOUBLE)", "CAST((event_id % 900 + 1) * 1000 + 500 AS DOUBLE)", "CAST(event_id % 1000 AS DOUBLE)", "CAST(event_id % 90 AS DOUBLE) + CAST(0.25 AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(617283 AS DOUBLE)"))


@query("f37_compact_values", f"""SELECT ord, CASE WHEN v IS NULL THEN 'n/a' WHEN v >= 1000000 THEN (ord + 1) || '.2M' WHEN v >= 1000 THEN CASE WHEN ord % 6 = 1 THEN (ord % 900 + 1) || '.5k' ELSE '617.3k' END WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) || '.25' END AS compact,
  repeat('#', n) || repeat('-', 18 - n) AS bar FROM (SELECT ord, v, CAST(greatest(0, least(18, round_even(coalesce(v, 0) / 1234567.0 * 18, 0))) AS BIGINT) AS n FROM {VALUES.sql})""")
def f37(spark, sf):
    return VALUES.rows(spark, sf).select("ord", report.compact(F.col("v")).alias("compact"), report.bar(F.col("v"), F.lit(1234567.0)).alias("bar"))


SCALARS = Made("conversations", conv_id="conv_id", turn="turn", v=case("(conv_id + turn) % 7", "text", "role || ': ' || text", "'true'", "'say \"' || role || '\"'", "'- ' || role", "''", f"text || {NL} || role"))
_RISKY = r"^$|^[\s\-?:,\[\]{}#&*!|>''\"%@`]|: |:$| #|^\s|\s$|\n|^(?i:true|false|null|yes|no|on|off|~)$|^[\d.+-]+$"


@query("f32_yaml_scalars", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(v, '{_RISKY}') THEN '"' || replace(replace(replace(v, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"' ELSE v END AS safe FROM {SCALARS.sql}""")
def f32(spark, sf):
    return SCALARS.rows(spark, sf).select("conv_id", "turn", markdown.yaml_safe(F.col("v")).alias("safe"))


# --- claims

BODIES = Made("orders", event_id="CAST(o_orderkey AS STRING)", body=case(
    "o_orderkey % 9", "'PS' || CAST(o_custkey % 10 AS STRING) || ' launch is on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' for all'", "'OKR status: ' || CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'yellow' ELSE 'red' END || ' now'", "'PS2 will not launch on 2024-06-01'",
    "'PS' || CAST(o_custkey % 10 AS STRING) || ' owner Alice' || o_orderstatus || ' Smith'", "'D0A8DQ7BP0U status: red'", "'MYPROJ decision: use Spark ' || CAST(o_custkey AS STRING)", "NULL", "'launch 2024-01-01 without project'", "'PS2 launch 2024-02-30'"))
CLAIMS = f"""SELECT event_id, CASE k WHEN 1 THEN 'project:okr' WHEN 5 THEN 'project:myproj' ELSE 'project:' || lower(split_part(body, ' ', 1)) END AS topic_key, CASE k WHEN 0 THEN 'launch-date' WHEN 1 THEN 'status' WHEN 3 THEN 'owner' ELSE 'decision' END AS claim_subject,
  CASE k WHEN 0 THEN split_part(body, ' ', 5) WHEN 1 THEN split_part(body, ' ', 3) WHEN 3 THEN lower(split_part(body, ' ', 3)) ELSE lower(body) END AS value FROM (SELECT *, CAST(event_id AS BIGINT) % 9 AS k FROM {BODIES.sql}) WHERE k IN (0, 1, 3, 5)"""


@query("f30_claim_extraction", CLAIMS)
def f30(spark, sf):
    return extract.claims(BODIES.rows(spark, sf)).select("event_id", "topic_key", "claim_subject", "value")


@query("x2_hybrid_extractor", f"SELECT * FROM ({CLAIMS}) UNION ALL SELECT event_id, 'misc', 'note', lower(body) FROM {BODIES.sql} WHERE CAST(event_id AS BIGINT) % 9 IN (2, 4, 7, 8)")
def x2(spark, sf):
    """A fallback takes what the rules find nothing in; it fails on missing texts, which give no claim."""

    def fallback(body):
        if body is None:
            raise ValueError("no text")
        return [("misc", "note", body.lower(), body)]

    return extract.claims(BODIES.rows(spark, sf), fallback=fallback).select("event_id", "topic_key", "claim_subject", "value")


# --- links and paths

LINKED = Made("documents", file=f"'f' || {ID} || '.md'", body=case(
    "doc_id % 3", f"'see [[Note ' || {ID} || '#Top]] and [[Gone ' || source || ']]' || {NL} || 'and [[note-' || {ID} || '.md|x]] [[<name>]]'", f"'code `/srv/' || source || '/n' || {ID} || '.md:12` [t](/gone/' || lang || '%20y.md) [w](https://x.y/z)' || {NL} || '`cat \"/srv/a b.md\" /tmp/q' || {ID} || '`'", "text"))
#: Notes that exist: of all ids but every fifth.
NAMES = Made("documents", doc_id="doc_id", name=f"'Note ' || {ID}", path=f"'/srv/' || source || '/n' || {ID} || '.md'")
DEAD_LINKS = """SELECT 'f' || doc_id || '.md' AS file, CAST(1 AS BIGINT) AS line, 'dead_wikilink' AS kind, 'Gone ' || source AS detail FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'f' || doc_id || '.md', 1, 'dead_wikilink', 'Note ' || doc_id || '#Top' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 = 0 UNION ALL SELECT 'f' || doc_id || '.md', 2, 'dead_wikilink', 'note-' || doc_id || '.md' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 = 0"""
DEAD_PATHS = """SELECT 'f' || doc_id || '.md' AS file, CAST(1 AS BIGINT) AS line, 'broken_local_link' AS kind, '/gone/' || lang || ' y.md' AS detail FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'f' || doc_id || '.md', 2, 'dead_path', '/tmp/q' || doc_id FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT 'f' || doc_id || '.md', 1, 'dead_path', '/srv/' || source || '/n' || doc_id || '.md' FROM documents WHERE doc_id % 3 = 1 AND doc_id % 5 = 0"""


@query("j5_dead_wikilinks", DEAD_LINKS)
def j5(spark, sf):
    return lint.wiki_links(LINKED.rows(spark, sf), NAMES.rows(spark, sf).where("doc_id % 5 <> 0").select("name"))


@query("j18_dead_paths", DEAD_PATHS)
def j18(spark, sf):
    listing = NAMES.rows(spark, sf).where("doc_id % 5 <> 0").select("path")
    return lint.dead_paths(LINKED.rows(spark, sf), listing.union(spark.createDataFrame([("/srv/a b.md",)], "path string")))


@query("t13_sorted_findings", f"{DEAD_LINKS} UNION ALL {DEAD_PATHS}")
def t13(spark, sf):
    return j5(spark, sf).union(j18(spark, sf)).orderBy("file", "line", "kind")


SPANS = Made("documents", ord="doc_id", span=case("doc_id % 4", f"'/Users/' || source || '/My Notes/p' || {ID} || '.md (old)'", f"'cat \"/x/My Notes/' || lang || '.md\" /y/z' || {ID} || '.md'", "'no path ' || lang", f"'~/a/' || {ID} || '.md.'"))


@query("f35_path_candidates", f"SELECT doc_id AS ord, {case('doc_id % 4', f'''{chr(39)}/Users/{chr(39)} || source || {chr(39)}/My Notes/p{chr(39)} || {ID} || {chr(39)}.md{chr(39)}''', f'''{chr(39)}/x/My Notes/{chr(39)} || lang || {chr(39)}.md|/y/z{chr(39)} || {ID} || {chr(39)}.md{chr(39)}''', chr(39) * 2, f'''{chr(39)}~/a/{chr(39)} || {ID} || {chr(39)}.md{chr(39)}''')} AS paths FROM documents")
def f35(spark, sf):
    return SPANS.rows(spark, sf).select("ord", F.array_join(lint.candidates("span"), "|").alias("paths"))


FOLDER = Made("documents", path=f"'docs/' || source || '/n' || {ID} || '.md'")
ASKS = ["docs/src5/n5.md", "docs/src1/", "n7.md", "n1", "zzz"]


@query("j16_resolve", f"""WITH p AS {FOLDER.sql}, a AS (SELECT unnest([{', '.join(f"'{x}'" for x in ASKS)}]) AS ask),
m AS (SELECT ask, path, CASE WHEN path = ask THEN 1 WHEN starts_with(path, ask) THEN 2 WHEN regexp_extract(path, '[^/]*$') = ask THEN 3 WHEN contains(path, ask) THEN 4 END AS level FROM p, a)
SELECT a.ask, count(m.path) AS matches, CASE WHEN count(m.path) = 1 THEN max(m.path) END AS resolved FROM a LEFT JOIN (SELECT *, min(level) OVER (PARTITION BY ask) AS best FROM m WHERE level IS NOT NULL) m ON m.ask = a.ask AND level = best GROUP BY 1""")
def j16(spark, sf):
    """A request's few names are sought in one pass over the listing; the best level is an aggregation."""
    path = F.col("path")
    level = lambda ask: F.when(path == ask, 1).when(path.startswith(ask), 2).when(F.regexp_extract("path", "[^/]*$", 0) == ask, 3).when(path.contains(ask), 4)
    found = FOLDER.rows(spark, sf).select("path", F.explode(F.array(*[F.struct(F.lit(a).alias("ask"), level(a).alias("level")) for a in ASKS])).alias("x")).select("path", "x.*").where("level is not null")
    levels = found.groupBy("ask", "level").agg(F.count(F.lit(1)).alias("matches"), F.max("path").alias("one"))
    best = levels.groupBy("ask").agg(F.min_by(F.struct("matches", "one"), "level").alias("b"))
    asks = spark.createDataFrame([(a,) for a in ASKS], "ask string")
    return asks.join(best, "ask", "left").select("ask", F.coalesce("b.matches", F.lit(0)).alias("matches"), F.when(F.col("b.matches") == 1, F.col("b.one")).alias("resolved"))
