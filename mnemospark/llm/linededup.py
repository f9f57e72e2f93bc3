"""Removal of lines that many documents share.

Lines are exploded, normalised and hashed to 128 bits; the documents of each hash are counted with
partial sums before the shuffle; hashes at or over the threshold mark their lines, and
each text is put together again from its unmarked lines, by position. Only hashes and
positions are joined on hashes, and such a join is one that Spark splits where a line is
hot; texts are shuffled once, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(common.BLANKS)), UPPER, SMALL)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, id_col: str = "doc_id", text_col: str = "text", count_copies: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` freed of common lines, and __n_lines, __n_dropped.

    A line is common if its key has ``min_length`` code points or more and occurs in
    ``min_docs`` rows or more; all its lines go, in every row. With ``count_copies`` off, rows of equal
    text count once. Null and empty texts are one empty line, and an empty key is never
    common at a ``min_length`` of 1. Repeated rows get equal results. Other columns stay as they are.
    """
    text = common.text_of(text_col)
    # The row itself travels in one column, so that no name of its columns clashes with those used here.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.split(text, "\n").alias("lines"), *common.row_key(id_col, text), *[c.alias(f"t{k}") for k, c in enumerate(common.row_key(text_col, F.lit("")))])
    keys = F.transform("lines", line_key)
    hashes = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"), (F.char_length(k) >= min_length).alias("c")))
    hashed = common.written(keyed.select("__k1", "__k2", hashes.alias("h"), *([] if count_copies else ["t0", "t1"])))
    each = hashed if count_copies else hashed.groupBy("t0", "t1").agg(F.first("h").alias("h"))
    counted = each.select(F.explode(F.array_distinct("h")).alias("h")).where("h.c").groupBy("h.a", "h.b").agg(F.count(F.lit(1)).alias("n"))
    common_lines = common.written(counted.where(F.col("n") >= min_docs).select("a", "b"))
    marks = (
        hashed.select("__k1", "__k2", F.posexplode("h").alias("pos", "h"))
        .select("__k1", "__k2", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"), F.col("h.c").alias("c"))
        .where("c").join(common_lines, ["a", "b"])
        .groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("at"))
    )
    joined = keyed.drop("t0", "t1").join(marks, ["__k1", "__k2"], "left")
    # Of marked positions p1 < p2 < ... the kept lines are the slices between; all is linear in the lines.
    at = F.array_sort(F.coalesce("at", F.array().cast("array<int>")))
    bounds = F.concat(F.array(F.lit(-1)), at, F.array(F.size("lines")))
    runs = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.slice("lines", F.element_at("bounds", k) + 2, F.element_at("bounds", k + 1) - F.element_at("bounds", k) - 1))
    kept = F.when(F.size("bounds") == 2, F.coalesce(F.col("whole").getField(text_col).cast("string"), F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    return joined.withColumn("bounds", bounds).select(
        *[(kept if c == text_col else F.col("whole").getField(c)).alias(c) for c in docs.columns],
        F.size("lines").cast("long").alias("__n_lines"), (F.size("bounds") - 2).cast("long").alias("__n_dropped"),
    )


def line_report(docs: DataFrame, min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept, for each row."""
    out = drop_common_lines(docs.select("doc_id", "text"), min_docs, min_length)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r
"""
