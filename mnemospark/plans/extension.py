"""Queries of the extension points: table functions, providers, registries, counters, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from .. import views
from ..functions import text
from ..operators import distil, extract, providers
from ..operators import runtime as O
from ..sources import adapters, jsonl, markdown
from ..storage import shared_folder
from .derived import BODIES, CLAIMS, LISTING
from .registry import ORACLES, query
from .runtime import runtime_events
from .text import TOKENS

CLAIM = T.StructType([T.StructField(c, T.StringType()) for c in ("topic_key", "claim_subject", "value", "raw")])


@query("x1_extractor_table_function", CLAIMS)
def x1(spark, sf):
    """The extractor as a Python table function, joined laterally."""

    class Extract:
        def eval(self, body: str):
            yield from extract.extract(body)

    spark.udtf.register("extract_claims", udtf(Extract, returnType=CLAIM))
    BODIES.rows(spark, sf).createOrReplaceTempView("__bodies")
    return spark.sql("SELECT event_id, topic_key, claim_subject, value FROM __bodies, LATERAL extract_claims(body)")


@query("x3_cached_answers", """SELECT doc_id AS id, h AS digest, '{"topic": "' || substr(h, 1, 8) || '", "value": "' || substr(h, 9, 8) || '"}' AS answer, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, sha256('extract' || chr(0) || text) AS h FROM documents)""")
def x3(spark, sf):
    """Answers for every document; those asked before come from the cache."""
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    first = providers.answered(d.where("id % 2 = 0"), providers.Offline(), "extract", ["topic", "value"])
    cache = distil.written(first.select("digest", "answer").distinct())
    return providers.answered(d, providers.Offline(), "extract", ["topic", "value"], cache)


COUNTERS = {"words": text.token_estimate, "quarter": lambda c: F.floor(F.length(c) / 4).cast("long")}


@query("x6_token_counters", f"SELECT doc_id, coalesce({TOKENS.format('text')}, 0) AS words, CAST(length(text) // 4 AS BIGINT) AS quarter FROM documents")
def x6(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", *[c(F.col("text")).alias(n) for n, c in COUNTERS.items()])


@query("x7_namespace_registry", views.with_views("ep", "SELECT origin AS namespace, action, count(*) AS n FROM ep WHERE origin IN ('team.inbox', 'session.digest') GROUP BY 1, 2"))
def x7(spark, sf):
    registry, e = extract.Registry(), views.episodes(spark, sf)
    for name in ("team.inbox", "session.digest"):
        registry.register(name, lambda t, name=name: t.where(F.col("origin") == name).groupBy(F.lit(name).alias("namespace"), "action").agg(F.count(F.lit(1)).alias("n")))
    registry.register("broken", lambda t: t.select("missing"))
    tables, _ = registry.run_all(e)
    out = None
    for t in tables.values():
        out = t if out is None else out.union(t)
    return out


@query("sk1_append_log", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 10 = 0")
def sk1(spark, sf):
    e, path = views.table(spark, sf, "events").select("event_id", "event_type"), f"{shared_folder(spark)}/log"
    jsonl.append(e, path)
    jsonl.append(e.where("event_id % 10 = 0"), path)
    return jsonl.read(jsonl.lines_of(spark, path), "event_id long, event_type string")


@query("sk2_rewrite", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def sk2(spark, sf):
    e, path = views.table(spark, sf, "events").select("event_id"), f"{shared_folder(spark)}/log"
    jsonl.replace(e, path)
    jsonl.replace(e.where("event_id % 3 = 0"), path)
    return spark.read.json(path)


@query("sc18_source_manifest", "SELECT coalesce(source, 'all') AS source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CASE WHEN sum(n_chars) > 100000 THEN 'large' ELSE 'small' END AS tier FROM documents GROUP BY ROLLUP (source)")
def sc18(spark, sf):
    out = views.table(spark, sf, "documents").rollup("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), "files", "bytes", F.when(F.col("bytes") > 100000, "large").otherwise("small").alias("tier"))


# Providers by name: some are not available here; a document's wish stands for a user's setting.
WISH = "CASE doc_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'local' WHEN 2 THEN 'unheard of' END"


@query("x4_provider_resolution", f"SELECT doc_id, wish, CASE WHEN wish = 'local' THEN 'local' ELSE 'spare' END AS provider FROM (SELECT doc_id, {WISH} AS wish FROM documents)")
def x4(spark, sf):
    """The named provider if it is available, else the first that is. Names are a few settings, so each is resolved once, on the driver."""

    class Named(providers.Offline):
        def __init__(self, name: str, there: bool):
            self.name, self.there = name, there

        def available(self) -> bool:
            return self.there

    known = {"remote": lambda: Named("remote", False), "spare": lambda: Named("spare", True), "local": lambda: Named("local", True)}
    found = {name: providers.resolve(name, known).name for name in ("remote", "local", "unheard of")}
    d = views.table(spark, sf, "documents").selectExpr("doc_id", f"{WISH} AS wish")
    chosen = F.try_element_at(F.create_map(*[F.lit(x) for kv in found.items() for x in kv]), F.col("wish"))
    return d.select("doc_id", "wish", F.coalesce(chosen, F.lit(providers.resolve(None, known).name)).alias("provider"))


@query("x5_policies")
def x5(spark, sf):
    """The replay under each policy, and under one of the user's own: the items that each session ends with."""
    own = {"largest_first": lambda i: (-i.tokens, i.id)}
    ops, out = O.translate(runtime_events(spark, sf)), None
    for name, order in (O.POLICIES | own).items():
        last = O.manifests(ops, policy=order).groupBy("session_id").agg(F.max_by(F.struct("item_ids"), F.struct("seq")).alias("m"))
        part = last.select(F.lit(name).alias("policy"), "session_id", F.array_join(F.array_sort("m.item_ids"), ",").alias("items"))
        out = part if out is None else out.union(part)
    return out


def registry():
    """Adapters of two formats over folders: JSON lines of events, and whole notes."""
    r = adapters.Registry()
    r.register(adapters.Adapter("lines", frozenset({"codex-cli"}), lambda spark, path: jsonl.read(jsonl.lines_of(spark, path), "doc_id long, source string").select("doc_id", "source")))
    r.register(adapters.Adapter("notes", frozenset({"claude-code-flat", "claude-code-mixed", "claude-code-nested"}), lambda spark, path: spark.read.parquet(path).select("doc_id", "source")))
    return r


@query("sc22_adapters", f"SELECT source, format, CASE WHEN format = 'codex-cli' THEN 'lines' WHEN starts_with(format, 'claude-code') THEN 'notes' END AS adapter FROM ({ORACLES['sc16_format_detection']})")
def sc22(spark, sf):
    """Which adapter takes each source; formats are a fixed list, so the registry is asked for each once."""
    r, formats = registry(), ["codex-cli", "claude-code-flat", "claude-code-mixed", "claude-code-nested", "cursor-plans", "cursor-rules", "unknown", "empty"]

    def name(fmt):
        try:
            return r.find(fmt).name
        except KeyError:
            return None

    named = F.create_map(*[F.lit(x) for f in formats if name(f) for x in (f, name(f))])
    return markdown.detect_format(LISTING.rows(spark, sf)).select("source", "format", F.try_element_at(named, F.col("format")).alias("adapter"))


@query("x8_adapter_dispatch", "SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'lines' ELSE 'notes' END AS adapter FROM documents")
def x8(spark, sf):
    """Half of the documents as a folder of JSON lines, half as notes; each folder is read by the adapter of its format."""
    d, base, r = views.table(spark, sf, "documents").select("doc_id", "source"), shared_folder(spark), registry()
    jsonl.append(d.where("doc_id % 2 = 0"), f"{base}/lines")
    d.where("doc_id % 2 = 1").write.parquet(f"{base}/notes")
    parts = [r.dispatch(spark, fmt, f"{base}/{name}", f"{base}/target").select("doc_id", "source", F.lit(name).alias("adapter")) for fmt, name in (("codex-cli", "lines"), ("claude-code-mixed", "notes"))]
    return parts[0].union(parts[1])
