"""Token sets, term bags and text normalisation as column functions.

Word classes are spelled out, since Java's ``\\w`` is ASCII: letters and digits of any script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

# The three stop lists; each belongs to one tokeniser and to no other.
STOP_WORDS = """
the a an and or but is are was were be been being have has had do does did will would should could may might must can
this that these those of in on at to for with by from as if then when where how why what it its their our we you i not no
""".split()
STOP_PROMPT = """
the and for you with this that have are was but not from your what how why when should would could did had has any all
into out about an a i is of on to it in be do im ive id
""".split()
STOP_TERMS = """
a an and are as at be by can did do does for from had has have how i if in into is it its me my not of on or our should so
than that the their them then there this to use was we what when where which who why with you your
""".split()

#: Terms that a task counts at once.
COUNTED = 500_000

WORD = r"[a-zA-Z][a-zA-Z0-9_-]{2,}"
PROMPT_TOKEN = r"[a-z0-9][a-z0-9\-_]+"
TERM = r"[a-z0-9_]+"
LETTERS = r"\p{L}\p{N}_"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop))


def word_set(text: Column) -> Column:
    """Distinct lower-cased content words of three characters or more, sorted."""
    return F.array_sort(F.array_distinct(_without(F.transform(_found(text, WORD), F.lower), STOP_WORDS)))


def prompt_tokens(text: Column) -> Column:
    """Distinct tokens of a prompt, sorted."""
    return F.array_sort(F.array_distinct(_without(_found(F.lower(text), PROMPT_TOKEN), STOP_PROMPT)))


def terms(text: Column) -> Column:
    """The bag of search terms, in order, repeats included."""
    return F.filter(_found(F.lower(text), TERM), lambda t: (F.length(t) > 1) & ~t.isin(STOP_TERMS))


def overlap_words(text: Column) -> Column:
    """Words longer than two characters; slashes and colons part words."""
    parts = F.split(F.translate(F.lower(text), "/:", "  "), r"\s+")
    return F.filter(parts, lambda t: F.length(t) > 2)


def token_estimate(text: Column) -> Column:
    """A word counts a quarter of its length, one at least; another visible character counts one."""
    chunks = _found(text, rf"[{LETTERS}]+|[^{LETTERS}\s]")
    size = lambda t: F.when(t.rlike(rf"^[{LETTERS}]"), F.greatest(F.lit(1), F.floor(F.length(t) / 4).cast("int"))).otherwise(F.lit(1))
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda n, t: n + size(t).cast("long"))


def normalized_claim(text: Column) -> Column:
    """Lower case, marks to blanks, runs of blanks to one, no blanks at the ends."""
    marks = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^{LETTERS}\s]", " ")
    return F.trim(F.regexp_replace(marks, r"\s+", " "))


def canonical_condition(text: Column) -> Column:
    """No zero-width characters, blanks collapsed and trimmed, lower case."""
    visible = F.regexp_replace(F.coalesce(text, F.lit("")), "[​‌‍⁠﻿]", "")
    return F.lower(F.trim(F.regexp_replace(visible, r"[\s ]+", " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sorted sets: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def slug(text: Column, fallback: str = "unknown", size: int = 80) -> Column:
    """Letters and digits in lower case, runs of anything else as one underscore."""
    joined = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", "_")
    cut = F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, size)
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def dashed_slug(text: Column, size: int = 60) -> Column:
    """ASCII letters and digits in lower case, parted by single dashes."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, size), "-+$", "")


def summary(reflection: Column, action: Column, size: int = 120) -> Column:
    return F.substring(F.trim(F.coalesce(F.nullif(reflection, F.lit("")), action, F.lit(""))), 1, size)


def indexed_text(name: Column, description: Column, body: Column) -> Column:
    """What is indexed of a document: the description counts three times."""
    return F.trim(F.concat_ws(" ", name, description, description, description, body))


def term_counts(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf) of a bag's terms for each key. Terms are counted within each row, so that no task holds more than a batch of rows;
    rows that share their key, or have none, are added up after that."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            upto, low = np.concatenate([[0], np.cumsum(size)]), 0
            while low < len(batch):  # some rows at once, or one
                high = max(low + 1, int(np.searchsorted(upto, upto[low] + COUNTED, "right")) - 1)
                row = np.repeat(np.arange(low, high), size[low:high])
                found = pa.table({"row": row, "term": batch.column(1).slice(low, high - low).flatten()}).group_by(["row", "term"]).aggregate([([], "count_all")])
                for part in found.to_batches(max_chunksize=COUNTED // 10):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(part.column("row")), part.column("term"), part.column("count_all")], names=[key, "term", "tf"])
                low = high

    bags = docs.select(F.col(key), terms(F.col(body)).alias("bag"))
    counted = bags.mapInArrow(task, T.StructType([docs.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
    shared = written(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("__key")))
    if shared.isEmpty():
        return counted
    same = F.col(key).eqNullSafe(F.col("__key"))
    return counted.join(shared, same, "left_anti").union(counted.join(shared, same, "left_semi").groupBy(key, "term").agg(F.sum("tf").alias("tf")))
