"""Document quality by Bradley-Terry ranking.

A document's strength is a linear function of features of its text. It is fitted to preference pairs, each
a document labelled good and one labelled bad, by the logistic loss of the difference of
their features. Documents are then split at a quantile of the score: the share of bad
ones among the labels, over all labelled training rows. Scores are scaled so that this quantile stands at ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the fit uses at most for each label: those of the smallest hashes of doc_id.
SAMPLE = 8000
#: Bins of one pass over the strengths for the quantile; a bin of no more rows is sorted.
BINS, BIN_ROWS = 1024, 10_000
#: Preference pairs of the fit, the penalty on weights, and the score at the quantile.
PAIRS, RIDGE, CUT = 60_000, 1e-3, 0.3

# Kinds of bytes; features are built on how often each follows each.
KINDS = 12
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b" ", b"\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"-()", b"|_=<>{}[]/\\~^`", b"#$%&*+@")):
    _KIND[list(_bytes)] = _k
_KIND[[*range(9), *range(14, 32), 127]] = 10
_KIND[128:] = 11
WIDTH = KINDS * KINDS + 8


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features for each text: pairs of kinds, sizes, and repetition of words and lines."""
    n = len(at) - 1
    size = np.diff(at)
    out = np.zeros((n, WIDTH))
    kind = _KIND[raw]
    text = np.repeat(np.arange(n), size)
    if len(raw) > 1:
        same = text[1:] == text[:-1]
        code = (text[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
        out[:, : KINDS * KINDS] = np.sqrt(np.bincount(code[same], minlength=n * KINDS * KINDS).reshape(n, -1) / np.maximum(size - 1, 1)[:, None])
    starts, ends, first = common.word_spans(raw, at)
    words = np.diff(first)
    own = np.repeat(np.arange(n), words)
    length = ends - starts

    def share_of_distinct(owner: np.ndarray, hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, owner))
        o, h = owner[order], hashes[order]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        return np.bincount(o[new], minlength=n) / np.maximum(count, 1)

    extra = out[:, KINDS * KINDS :]
    extra[:, 0] = np.log1p(size) / 10
    extra[:, 1] = np.log1p(words) / 10
    mean = np.bincount(own, length, minlength=n) / np.maximum(words, 1)
    extra[:, 2] = np.minimum(mean, 40) / 10
    extra[:, 3] = np.minimum(np.sqrt(np.maximum(np.bincount(own, length.astype(float) ** 2, minlength=n) / np.maximum(words, 1) - mean**2, 0)), 40) / 10
    extra[:, 4] = share_of_distinct(own, common.span_hashes(common.LOWER[raw], starts, ends), words)
    cut = np.unique(np.concatenate([at[:-1], np.flatnonzero(raw == 10) + 1]))
    cut = cut[cut < len(raw)]
    line_end = np.append(cut[1:], len(raw)) if len(cut) else cut
    line_own = np.searchsorted(at, cut, side="right") - 1
    lines = np.bincount(line_own, minlength=n)
    extra[:, 5] = share_of_distinct(line_own, common.span_hashes(raw, cut, line_end), lines)
    extra[:, 6] = np.log1p(lines) / 10
    extra[:, 7] = size == 0
    return out


class Model(NamedTuple):
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x @ self.weights - self.cut) / self.scale, -30, 30)
        return 1 / (1 + np.exp(-(s + np.log(CUT / (1 - CUT)))))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fits strengths to pairs of good and bad rows by Newton's method. The cut is left at zero."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model(np.zeros(WIDTH), 0.0 if not len(bad) else 1.0, 1.0)
    rng = np.random.default_rng(seed)
    a, b = good[rng.integers(len(good), size=PAIRS)], bad[rng.integers(len(bad), size=PAIRS)]
    w = np.zeros(WIDTH)
    for _ in range(12):
        grad, hess = RIDGE * PAIRS * w, RIDGE * PAIRS * np.eye(WIDTH)
        for k in range(0, PAIRS, 5000):
            d = a[k : k + 5000] - b[k : k + 5000]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # that the bad one is preferred
            grad -= d.T @ p
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = x @ w
    return Model(w, 0.0, max(float(np.abs(s[y == 1].mean() - s[y == 0].mean())) / 6, 1e-9))


def quantile(rows: DataFrame, column: str, share: float) -> float:
    """Halfway between the last of the lowest ``share`` of all values and the next one.

    Values are counted in bins, and the bin that holds the place is cut into bins again, until
    it is small enough to be sorted or its values are equal. Without values it is zero.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return 0.0
    place = min(max(int(np.ceil(share * n)) - 1, 0), n - 1)  # from zero
    before, held = 0, n
    while held > BIN_ROWS and low < high:
        width = (high - low) / BINS
        number = F.least(F.lit(BINS - 1), F.floor((F.col(column) - low) / width)) if width else F.lit(0)
        bins = rows.where(F.col(column).between(low, high)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("bin").collect()
        for r in bins:
            if before + r["n"] > place:
                low, high, held = r["low"], r["high"], r["n"]
                break
            before += r["n"]
    if low == high:
        here = low if before + held > place + 1 else None
    else:
        values = sorted(r[0] for r in rows.where(F.col(column).between(low, high)).select(column).collect())
        low = values[place - before]
        here = values[place - before + 1] if place - before + 1 < len(values) else None
    if here is None:
        here = rows.where(F.col(column) > high).agg(F.min(column)).first()[0]
    return float(low if here is None else (low + here) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Model:
    """Learns from labels of rows whose crc32(id as text) mod ``folds`` is not 0.

    The fit uses at most ``sample`` ids of each label, those that hash lowest, and of an id with several texts the one that
    hashes lowest, so what the driver gathers has that bound. The quantile is taken over all labelled training rows. Ids with
    two different labels, and null labels, are left out; repeated labels count once. Without rows of both labels all scores are equal.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("__y"))
    known = common.written(one.where((F.col("y") == F.col("__y")) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)).select("doc_id", (F.col("y") > 0).cast("int").alias("y")))
    share = known.agg(F.avg(1.0 - F.col("y"))).first()[0] or 0.0
    some = common.lowest_hashed(known.where("y = 0"), "doc_id", sample).union(common.lowest_hashed(known.where("y = 1"), "doc_id", sample))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch):
                x = features(raw, at).astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    found = sorted((r["doc_id"], bytes(r["x"]), r["y"]) for r in rows.mapInArrow(common.lean(task), "doc_id long, y int, x binary").collect())
    x = np.array([np.frombuffer(r[1], "<f4") for r in found], float).reshape(-1, WIDTH)
    model = fit(x, np.array([r[2] for r in found], int))
    if not model.weights.any():
        return model
    weights = model.weights

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(features(raw, at) @ weights)], names=["doc_id", "s"])

    # All documents are scored where they are read, and only their scores meet the labels: texts are not shuffled.
    labelled = common.written(texts.mapInArrow(common.lean(strengths), "doc_id long, s double").join(known.select("doc_id"), "doc_id").select("s"))
    return model._replace(cut=quantile(labelled, "s", share))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null texts count as empty, and empty texts get the score of their (empty) features. A null id is not held out.
    Other columns are ignored.
    """
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=1 << 20):
                s = model.score(features(raw, at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), common.text_of(text_col).alias("text")).mapInArrow(common.lean(task), "doc_id long, held_out boolean, score double, predicted int")
