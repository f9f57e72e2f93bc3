"""How far the sources of a language are apart in their words.

The sources of a language are compared over an inverted index. Every pair of sources starts at a baseline, the distance it would
have if no term occurred in either: V times the difference of what a count of zero gives them. Postings then correct the
baseline, and only where a correction is not zero:

* A posting of a source by itself moves its distance to all others, which depends on the other source by its zero alone. These
  corrections are read off the source's histogram of counts, in one run along values for all others at once.
* Two postings of one term correct what the two single corrections got wrong.

Terms are ranked in windows. All sums are of whole numbers, in 64 bits where their bound allows it and in decimals where counts are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import text_of, written

#: What a term is made of, [^\x00-\x40\x5B-\x60\x7B-\x7F]: all characters beyond ASCII, and its letters.
TERM = np.zeros(256, dtype=bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
#: Bytes of texts whose terms a task counts at once.
COUNTED = 4 << 20
SCALE = 1_000_000_000


def terms_of(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, in order, with A-Z in lower case, and how many each text has."""
    inside = TERM.take(raw)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    first[at[:-1][full]] = inside[at[:-1][full]]
    last[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts = np.flatnonzero(first)
    ends = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts))
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(common.LOWER.take(raw[inside]))])
    return terms, np.diff(np.searchsorted(starts, at))


def occurrences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and the rows that hold it. One pass over texts; tasks count the terms of
    a few megabytes at once, and Spark sums these counts before it shuffles them."""
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=COUNTED):
                terms, per = terms_of(raw, at)
                terms, langs, sources = (x.dictionary_encode() for x in (terms, part.column(0), part.column(1)))
                code = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                many, wide = max(1, len(terms.dictionary)), len(sources.dictionary)
                group = code(langs) * wide + code(sources)
                # First each text's terms, with their number; then each group's, over its texts.
                both, n = np.unique(np.repeat(np.arange(len(part)), per) * many + code(terms), return_counts=True)
                text, term = np.divmod(both, many)
                key, place = np.unique(group[text] * many + term, return_inverse=True)
                at_group, term = np.divmod(key, many)
                total, held = np.bincount(place.ravel(), n, len(key)).astype(np.int64), np.bincount(place.ravel(), minlength=len(key))
                taken = [langs.dictionary.take(pa.array(at_group // wide)), sources.dictionary.take(pa.array(at_group % wide)), terms.dictionary.take(pa.array(term)).cast(pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(total), pa.array(held)], names=["lang", "source", "term", "n", "docs"])

    texts = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of(text_col).alias("text"))
    counts = texts.mapInArrow(common.lean(task), "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, smooth: int = 5) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * kept)), exactly: the product may be beyond 64 bits."""
    top = (count + smooth).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, (total + smooth * kept).cast("decimal(20,0)"))


def index(docs: DataFrame, min_docs: int = 30, smooth: int = 5) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, total, kept, zero) that occur, and the postings (lang, source, term, p, q) of kept terms: p is the
    group's share and q the language's."""
    found = written(occurrences(docs))
    terms = written(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= min_docs).drop("docs"))
    languages = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("whole"))
    held = written(found.drop("docs").join(terms, ["lang", "term"]))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    occurring = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    groups = occurring.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "kept", "whole"])
    # Without kept terms nothing is divided; the zero is then of no account.
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"), smooth)).otherwise(0)
    groups = written(groups.select("lang", "source", "total", "kept", "whole", zero.alias("zero")))
    postings = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept"), smooth).alias("p"), share(F.col("all"), F.col("whole"), F.col("kept"), smooth).alias("q"), "zero",
    )
    return groups, written(postings)


def pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language: the sum of the differences over all kept terms."""
    one = groups.select("lang", "source", "kept", "zero")
    two = one.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero2"))
    every = one.join(two, "lang").where("source <> item")  # these are the rows of the result

    # Alone: the postings of a source, where another has none. The sum of min(p, zero2) - zero over them, by a run along their values.
    histogram = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("h"))
    none = F.lit(None)
    marks = histogram.select("lang", "source", F.col("p").alias("at"), F.lit(0).alias("kind"), "h", none.cast("string").alias("item"))
    marks = marks.union(every.select("lang", "source", "zero2", F.lit(1), F.lit(0).cast("long"), "item"))
    whole = Window.partitionBy("lang", "source")
    run = whole.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = marks.select(
        "lang", "source", "item", F.sum("h").over(run).alias("below"), F.sum(F.when(F.col("kind") == 0, F.col("h") * F.col("at"))).over(run).alias("mass"),
        F.sum("h").over(whole).alias("terms"), F.sum(F.when(F.col("kind") == 0, F.col("h") * F.col("at"))).over(whole).alias("all"),
    ).where("item is not null")
    c, zero = F.col, F.coalesce
    reach = zero("mass", F.lit(0)) - c("zero") * c("below") + (c("terms") - c("below")) * (c("zero2") - c("zero"))
    lone = zero("all", F.lit(0)) - c("zero") * c("terms") - 2 * F.when(c("zero2") > c("zero"), reach).otherwise(0)
    alone = every.join(sums, ["lang", "source", "item"]).select("lang", "source", "item", lone.alias("v"))

    # Together: two postings of one term, each unordered pair once, counted for both directions.
    left = postings.select("lang", "term", "source", "p", "zero")
    right = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("zero").alias("zero2"))
    fix = F.abs(c("p") - c("p2")) - F.abs(c("p") - c("zero2")) - F.abs(c("p2") - c("zero")) + F.abs(c("zero") - c("zero2"))
    met = left.join(right, ["lang", "term"]).where("source < item").select("lang", "source", "item", fix.alias("v")).where("v <> 0").groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))

    mirrored = lambda t: t.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    base = every.select("lang", "source", "item", (c("kept") * F.abs(c("zero") - c("zero2"))).alias("v"))
    parts = base.union(alone).union(mirrored(alone)).union(met).union(mirrored(met))
    return parts.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, smooth: int = 5) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text).

    Part ``pair``: every other source of the language, by the distance over all terms that ``min_docs`` of its rows hold. Part
    ``term``: the ``top`` terms of which the source has more than its language. Nulls in any of the columns count as empty strings and
    an empty string is a language or source like any other; texts are taken whole; rows are documents, repeated ones too; ties go by item;
    a language without kept terms has pairs of value 0; an empty table gives no rows; other columns are not read.
    """
    groups, postings = index(docs, min_docs, smooth)
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = lambda t, part: t.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return place(pairs(groups, postings), "pair").union(place(terms, "term").where(F.col("rank") <= top))


AUDIT_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), k AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) USING (lang, source)),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) JOIN v USING (lang)
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY 1, 2, 3) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
) WHERE part = 'pair' OR rank <= 50
"""
