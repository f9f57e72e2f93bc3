"""What the training-data operators share: scratch tables, row keys, views of text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, written

#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The characters of [\x20\x09-\x0D], for SQL's trim.
BLANKS = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most 4 MB or one row, and readers take 512 rows at once, so that long texts fill neither the
    JVM's buffers nor a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, giving memory back to the machine at its end: Python workers live on, side by side with the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text: Column) -> list[Column]:
    """Two 64-bit hashes of id and text: rows of equal key are repeats of one row."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")), text]
    return [F.xxhash64(*parts).alias("__k1"), F.xxhash64(F.lit(1), *parts).alias("__k2")]


def lowest_hashed(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of distinct ids whose hashes are lowest, or all if there are fewer. Rows that cannot be among them are
    filtered out where they are read, so that what is sorted does not grow with the table; where too few hash below
    the bound, it is doubled."""
    space = 1 << 40
    place = F.pmod(F.xxhash64(id_col), F.lit(space))
    total = rows.count()
    bound = min(space, int(space * 1.5 * n / max(1, total)) + (space >> 20))
    while bound < space and rows.where(place < bound).count() < min(n, total):
        bound = min(space, 2 * bound)
    return rows.where(place < bound).orderBy(place, id_col).limit(n)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, the end last. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``limit`` bytes of text, with bytes and offsets."""
    raw, at = utf8(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (end last)."""
    inside = ~SPACE.take(raw)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = inside[edge]
    edge = at[1:][at[:-1] < at[1:]] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by one running sum over all bytes."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words that ``word_spans`` has found in ``raw`` as an Arrow array of binaries."""
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=out[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(out), pa.py_buffer(raw[~SPACE.take(raw)])])
