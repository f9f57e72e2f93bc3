"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before has kept. All but the last return the
columns of documents, whatever their names, in their order. In all stages a null text counts as an empty one, null ids are
ids of their own kind, texts are taken whole however long, rows of equal id and text are repeats of one row,
and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import common, decontam, langid, linededup, neardup, packing


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as one column, whatever its columns are called, and its key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *common.row_key("doc_id", common.text_of()))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose keys (__k1, __k2) are in ``rows``."""
    return _keyed(docs).join(common.written(rows.select("__k1", "__k2").distinct()), ["__k1", "__k2"], "left_anti").select("whole.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the evidence settles. Texts without letters go, null and empty ones among them; repeats go or stay together."""
    rows = langid.document_rows(docs)
    return _without(docs, langid.identify(rows, *langid.learn(rows)).where(~F.col("accepted")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frees texts of lines that ten different texts share. Copies of one text count once: the next
    stage takes them, and their lines are no boilerplate. Every document stays; a null text becomes an empty one."""
    out = linededup.drop_common_lines(docs, count_copies=False).drop("__n_lines", "__n_dropped")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (0.8 of five-word shingles or more) the document of the smallest id.

    Candidates are SimHash fingerprints within four bits, linked by BK-trees (``simhash``). These do not reach down to a similarity of 0.8, so
    MinHash buckets add the others, and all are verified; see the README. Null ids come after all others; of equal ids the row whose key is smallest stays, once. Texts without words are one group.
    """
    groups = neardup.near_duplicates(docs, width=5, threshold=0.8)
    least = groups.groupBy("__component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__k1", "__k2")).alias("one"))
    kept = common.written(least.select("one.__k1", "one.__k2"))
    return _keyed(docs).join(kept, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]).select("whole.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, 0.8 of its five-word shingles or more. Texts and items without words are in no pair."""
    return _without(docs, decontam.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; an empty text is its end token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language likelihoods, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
