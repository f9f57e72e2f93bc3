"""Benchmark decontamination: items that documents contain, by MinHash containment search.

Both sides are signed by the smallest values of one hash over their distinct shingles (bottom sketches, the MinHash of one hash
and many values). An item of n shingles has the smallest floor((1 - t) * n) + 1 of them as its signature. Items are partitioned by size; the largest
value in a partition's signatures is the partition's bound. A document's signature for a partition is every one of its
hashes up to that bound, so it grows with the document, and the signatures of a short item and a long document stay comparable.
A document that contains at least t * n of the item's shingles lacks at
most (1 - t) * n, so it holds one of the item's signature: no such pair is missed, however long the document. (Signatures of a fixed
number of values, as banding takes, would miss it: the Jaccard similarity of an item of 20 shingles and a document of 20 000 is
0.0008.) A common value is a candidate; it is verified by counting exact shingles.

Items are handled in blocks of about ``BLOCK_SHINGLES`` shingles, whatever their number, one after the other:
what the driver and a task hold of them has that bound, and more items mean more passes over the documents.
Documents are read once a block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Shingles of the items of a block: about 100 MB in a task.
BLOCK_SHINGLES = 1_000_000


def word_list(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """Distinct shingles; fewer words than ``width`` are one shingle, none are none."""
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _roll(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row, from the words' hashes."""
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
    return common.mixed(out + np.uint64(width))


class Items:
    """A block of items: their signatures by size partition, and their shingles for the exact count."""

    def __init__(self, rows: list[tuple[int, str]], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.ids, self.shingles, self.hashes = [], [], []
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in rows:
            words = word_list((text or "").encode())
            if not words:
                continue
            raw, at = common.utf8(pa.array([text]))
            starts, ends, _ = common.word_spans(raw, at)
            size = min(width, len(words))
            hashes = np.unique(_roll(common.span_hashes(common.LOWER[raw], starts, ends), size))
            k = len(self.ids)
            self.ids.append(item_id)
            self.shingles.append(shingle_set(words, width))
            self.hashes.append(hashes)
            n = len(hashes)
            sketch = hashes[: int((1 - threshold) * n + 1e-9) + 1]
            by.setdefault((size, int(n).bit_length()), []).extend((int(x), k) for x in sketch)
        self.parts = []
        for (size, _), pairs in sorted(by.items()):
            pairs.sort()
            self.parts.append((size, np.array([x for x, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)))

    def hits(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shingles found) for the pairs at or over the threshold."""
        starts, ends, first = common.word_spans(raw, at)
        if not len(starts):
            return
        hashes = common.span_hashes(common.LOWER[raw], starts, ends)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found: list[np.ndarray] = []
        rolled: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, sketch, owner in self.parts:
            if size > len(hashes):
                continue
            if size not in rolled:
                whole = text[: len(text) - size + 1] == text[size - 1 :]  # no shingle reaches into the next text
                rolled[size] = _roll(hashes, size)[whole], text[: len(text) - size + 1][whole]
            h, t = rolled[size]
            small = np.flatnonzero(h <= sketch[-1])
            low = np.searchsorted(sketch, h[small])
            hit = sketch[np.minimum(low, len(sketch) - 1)] == h[small]
            small, low = small[hit], low[hit]
            many = np.searchsorted(sketch, h[small], side="right") - low
            upto = np.cumsum(many)
            places = np.repeat(low - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)
            found.append(np.unique(np.repeat(t[small], many) * len(self.ids) + owner[places]))
        for code in np.unique(np.concatenate(found)) if found else []:
            d, k = divmod(int(code), len(self.ids))
            need = self.threshold * len(self.shingles[k]) - 1e-9
            size = min(self.width, len(next(iter(self.shingles[k]))))
            h = _roll(hashes[first[d] : first[d + 1]], size)
            if np.isin(self.hashes[k], h).sum() >= need:
                words = word_list(raw[at[d] : at[d + 1]].tobytes())
                own = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
                if (n := len(self.shingles[k] & own)) >= need:
                    yield d, k, n


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment, and the row's key, for the pairs at or over the threshold.

    Null, empty and blank texts and items are in no pair. An item of fewer words than
    ``width`` is one shingle of all its words. Repeated rows of either table give repeated pairs, and equal containments are
    pairs each. Texts of any length are searched whole. Null ids stay null. Empty tables give no pairs. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    text = common.text_of(text_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *common.row_key(id_col, text))
    wanted = common.written(items.select(F.col(item_id).cast("long").alias("item_id"), common.text_of(item_text).alias("text")))
    size = F.size(F.split(F.col("text"), r"[\x20\x09-\x0D]+")).cast("long")
    total = wanted.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * total // BLOCK_SHINGLES)) if total > BLOCK_SHINGLES else 1
    # Rows are dealt to blocks by hashes of their places, so that repeats of one item are spread as well: about half the bound in each.
    dealt = common.written(wanted.withColumn("b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))) if n_blocks > 1 else wanted.withColumn("b", F.lit(0))
    out = None
    for number in range(n_blocks):
        block = [(r["item_id"], r["text"]) for r in dealt.where(F.col("b") == number).collect()]
        held = spark.sparkContext.broadcast(Items(block, width, threshold))

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                for part, raw, at in common.slices(batch):
                    pairs = list(known.hits(raw, at))
                    if pairs:
                        d = pa.array([p[0] for p in pairs])
                        n = [len(known.shingles[k]) for _, k, _ in pairs]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(d), pa.array([known.ids[k] for _, k, _ in pairs], pa.int64()), pa.array(n, pa.int64()), pa.array([p[2] for p in pairs], pa.int64()), pa.array([p[2] / m for p, m in zip(pairs, n)]), part.column(2).take(d), part.column(3).take(d)],
                            names=["doc_id", "item_id", "n_shingles", "n_found", "containment", "__k1", "__k2"],
                        )

        found = read.mapInArrow(common.lean(task), "doc_id long, item_id long, n_shingles long, n_found long, containment double, __k1 long, __k2 long")
        if n_blocks > 1:  # one block's items go before the next one's come
            found = common.written(found)
            held.unpersist()
        out = found if out is None else out.union(found)
    return out


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))"
#: The pairs by joining all shingles, for ``documents`` and ``benchmark``.
CONTAINED_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS k, item_id, w, least(5, len(w)) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
  sought AS (SELECT k, item_id, s, {_SHINGLES} AS g FROM items),
  sizes AS (SELECT k, count(*) AS n FROM sought GROUP BY 1),
  texts AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
  held AS (SELECT d, doc_id, s, {_SHINGLES} AS g FROM texts, (SELECT DISTINCT s FROM items) WHERE len(w) >= s)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment
FROM (SELECT d, doc_id, k, item_id, count(*) AS n_found FROM held JOIN sought USING (s, g) GROUP BY ALL) JOIN sizes USING (k)
WHERE n_found >= 0.8 * n - 1e-9"""
