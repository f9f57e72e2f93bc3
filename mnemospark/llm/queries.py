"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, divergence, langid, licences, linededup, lm, media, packing, quality, secrets, simhash, tokenfile

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document. As documents have no paths, source and id stand in: every
    tenth document is the licence file of a directory of a hundred, in one of a thousand."""
    docs = table(spark, sf_dir, "documents")
    group = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("text-"), F.col("doc_id")))
    files = docs.select("doc_id", F.concat_ws("/", "source", F.concat(F.lit("k"), group(1000)), F.concat(F.lit("h"), group(100)), name).alias("path"), "text")
    return licences.scan(files, id_col="doc_id").withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, lines that ten documents share, and the digest of the rest."""
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and digest of each document's ids, from the files written."""
    return tokenfile.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain, by 0.8 of their five-word shingles or more."""
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("__k1", "__k2")


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of each document's transport stream, read back."""
    return media.read_media(media.write_media(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under the mixed model and under the unigram base."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document and whether it is accepted."""
    rows = langid.document_rows(table(spark, sf_dir, "documents"))
    return langid.identify(rows, *langid.learn(rows)).select(F.col("id").alias("doc_id"), "language", "posterior", "text_language", "accepted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a byte-level and a piece vocabulary align over each document."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each web page, from text, markup, address suffix and host."""
    known = langid.learn(langid.document_rows(table(spark, sf_dir, "documents")))
    return langid.identify(langid.page_rows(table(spark, sf_dir, "pages")), *known).select(F.col("id").alias("page_id"), "language", "posterior", "text_language", "accepted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to packed sequences."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing, "op2_licences": op2_licences, "op3_line_dedup": op3_line_dedup, "op4_simhash": op4_simhash,
    "op5_token_file": op5_token_file, "op6_decontamination": op6_decontamination, "op7_transport_stream": op7_transport_stream,
    "op8_quality": op8_quality, "op9_context_mixing": op9_context_mixing, "op10_language": op10_language,
    "op11_alignment": op11_alignment, "op12_secrets": op12_secrets, "op13_divergence": op13_divergence,
    "language_of_pages": language_of_pages, "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": linededup.LINE_SQL, "op6_decontamination": decontam.CONTAINED_SQL, "op13_divergence": divergence.AUDIT_SQL}
