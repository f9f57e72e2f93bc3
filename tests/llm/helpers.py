import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Extra columns named like those that operators use inside.
CLASHING = ["fp", "key", "pos", "h", "n", "ids", "path", "__k1", "__k2", "__lines", "row", "token", "start", "id", "a", "b", "declared"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, rows, extra=False, partitions=3):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "src1")[len(r) - 2 :], len(r[1]) if r[1] is not None else None) if len(r) == 2 else (*r, len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(partitions, "doc_id") if full else spark.createDataFrame([], SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


#: Nulls, empty, blank, repeated, tied and long texts, and a null id.
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (5, "One"), (6, "a b c d e f g"), (7, "a b c d e f h"), (None, "null id text"),
    (8, "x\n" * 40 + "é ß 日本 語"), (9, "word " * 6000), (10, "the quick brown fox\njumps over the lazy dog"), (11, "the quick brown fox\njumps over the lazy dog\nand more"),
    (12, "\n"), (13, "don't  stop <|endoftext|> now\r\n\x0b tab"), (14, "Ünïcode Ça va? ΑΣ"),
]
