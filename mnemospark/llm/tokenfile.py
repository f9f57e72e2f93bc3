"""Token ids in seekable zstandard files.

A shard holds one zstandard frame for each document, in ascending order of ids: its token ids, little-endian,
in two bytes each where the vocabulary allows it, else four. Behind the frames come a skippable frame
with the documents' ids, and the seek table of zstandard's seekable format: compressed and
decompressed size and the low 32 bits of XXH64 (seed 0) for each frame, the number of
frames, and the magic number at the very end. Any zstandard reader can decompress a shard
whole; ``Reader`` reads the tail and then only the frames of the documents asked for.

Shards are written through pyarrow's file systems into the shared folder. A task writes a
file of its own name for each attempt, and only names that reach the written manifest are read, so
a lost executor leaves no half-written shard in the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Fixed values of the zstandard seekable format.
SKIPPABLE_SEEK, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SKIPPABLE_INDEX = 0x184D2A50
#: A task begins another shard at so many bytes of ids or documents, so that a shard's index stays small.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 500_000
#: Bytes that are read at once where frames lie side by side.
READ_BYTES = 8 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Appends documents to a shard. Sizes of one frame are limited to 4 GB by the format."""

    def __init__(self, sink, width: int, level: int = 3):
        self.sink, self.width = sink, width
        self.entries, self.ids = bytearray(), []
        self.squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.squeeze(ids)
        self.sink.write(frame)
        self.entries += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids, 0) & 0xFFFFFFFF)
        self.ids.append(doc_id)

    def close(self) -> None:
        n = len(self.ids)
        index = struct.pack("<B", self.width) + np.array([x is not None for x in self.ids], np.uint8).tobytes()
        index = zstandard.ZstdCompressor().compress(index + np.array([x or 0 for x in self.ids], "<i8").tobytes())
        index += struct.pack("<I", len(index))
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = bytes(self.entries) + struct.pack("<IBI", n, 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Reads documents of a shard by their place in it; checks each frame's checksum."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums at the end")
        head = end - 9 - 12 * n - 8
        table = np.frombuffer(self._at(head + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.first = np.concatenate([[0], np.cumsum(self.packed)])
        (size,) = struct.unpack("<I", self._at(head - 4, 4))
        index = zstandard.ZstdDecompressor().decompress(self._at(head - 4 - size, size))
        self.width = index[0]
        there, ids = np.frombuffer(index, np.uint8, n, 1), np.frombuffer(index, "<i8", n, 1 + n)
        self.ids = [int(x) if ok else None for ok, x in zip(there, ids)]

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(size))

    def documents(self, places: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place, ids) in the file's width; frames side by side are read together."""
        places = range(len(self.ids)) if places is None else sorted(places)
        grow = zstandard.ZstdDecompressor().decompress
        k = 0
        while k < len(places):
            stop = k + 1
            while stop < len(places) and places[stop] == places[stop - 1] + 1 and self.first[places[stop] + 1] - self.first[places[k]] <= READ_BYTES:
                stop += 1
            base = self.first[places[k]]
            data = self._at(base, self.first[places[stop - 1] + 1] - base)
            for p in places[k:stop]:
                frame = data[self.first[p] - base : self.first[p + 1] - base]
                ids = grow(frame, max_output_size=int(self.plain[p])) if self.plain[p] else b""
                if len(ids) != self.plain[p] or xxhash.xxh64_intdigest(ids, 0) & 0xFFFFFFFF != self.sums[p]:
                    raise ValueError(f"frame {p} is damaged")
                yield p, ids
            k = stop


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids as little-endian bytes of ``width``, end id last."""
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=tokens.ENCODE_BYTES):
                ids, first = encode(raw, at, end_id)
                if width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("the vocabulary needs four bytes for an id")
                data = np.ascontiguousarray(ids.astype(f"<u{width}"))
                column = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(common.lean(task), "doc_id long, ids binary")


def write_shards(ids: DataFrame, width: int, folder: str | None = None) -> DataFrame:
    """Writes (doc_id, ids) in order of doc_id, nulls first; the manifest has a row for each shard.

    Rows are dealt by ranges of doc_id and a hash of their ids, so that rows of one doc_id, or without any, fall to several
    tasks if they are many. A task writes shards of at most ``SHARD_BYTES`` and ``SHARD_DOCS``, a document more in bytes.
    """
    spark = ids.sparkSession
    folder = folder or common.shared_folder(spark)
    limit, most = SHARD_BYTES, SHARD_DOCS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, sink, path, total = TaskContext.get().partitionId(), 0, None, None, "", 0
        store, place = file_system(folder)

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            known = [x for x in writer.ids if x is not None] or [None]
            numbers = {"n_docs": len(writer.ids), "n_tokens": total, "low": known[0], "high": known[-1]}
            return pa.RecordBatch.from_pydict({"shard": pa.array([part << 32 | number], pa.int64()), "path": [path]} | {k: pa.array([v], pa.int64()) for k, v in numbers.items()})

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is not None and (total * width >= limit or len(writer.ids) >= most):
                    yield closed()
                    writer, number, total = None, number + 1, 0
                if writer is None:
                    path = f"{place}/shard-{part:07d}-{number:05d}-{uuid.uuid4().hex}.zst"
                    sink = store.open_output_stream(path, compression=None, buffer_size=1 << 20)
                    writer = Writer(sink, width)
                data = data.as_buffer().to_pybytes()
                writer.add(doc_id, data)
                total += len(data) // width
        if writer is not None:
            yield closed()

    hashed = ids.withColumn("__h", F.xxhash64("ids"))
    ordered = hashed.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h", "ids").select("doc_id", "ids")
    manifest = common.written(ordered.mapInArrow(common.lean(task), "shard long, path string, n_docs long, n_tokens long, low long, high long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return common.written(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the shards of a manifest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = file_system(row["folder"])
                with store.open_input_file(row["path"]) as source:
                    reader, start = Reader(source), row["start"]
                    out: list[tuple] = []
                    for p, data in reader.documents():
                        ids = np.frombuffer(data, f"<u{reader.width}").astype("<u4")
                        out.append((reader.ids[p], start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    shards = manifest.count()
    return manifest.repartition(max(1, shards), "shard").mapInArrow(common.lean(task), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in ``wanted`` (doc_id); only their frames are decompressed.

    The driver holds the first id of each shard (a row for each file, not for each document).
    Ids that stand at a border of two shards are sought in both.
    """
    rows = manifest.select("folder", "path", "low", "high").where("high is not null").orderBy("shard").collect()
    files = [(r["folder"], r["path"]) for r in rows]
    low, high = (np.array([r[k] for r in rows], np.int64) for k in ("low", "high"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.drop_null(batch.column(0)).to_numpy()
            first, last = np.searchsorted(high, ids), np.searchsorted(low, ids, side="right")
            many = np.maximum(last - first, 0)
            shard = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, many)), pa.array(shard)], names=["doc_id", "shard"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for shard in np.unique(shards):
                folder, path = files[shard]
                with file_system(folder)[0].open_input_file(path) as source:
                    reader, sought = Reader(source), set(ids[shards == shard].tolist())
                    for p, data in reader.documents([k for k, x in enumerate(reader.ids) if x in sought]):
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([reader.ids[p]], pa.int64()), "ids": [np.frombuffer(data, f"<u{reader.width}").astype(np.int64).tolist()]})

    dealt = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(deal, "doc_id long, shard long")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(common.lean(task), "doc_id long, ids array<long>")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids and reads them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before. Null and empty texts hold the end id alone. Null
    ids come first; repeated ids lie side by side, ordered by a hash of their token ids. Other
    columns are ignored. An empty table writes no file and gives no rows.
    """
    return read_shards(write_shards(common.written(tokenized(docs, tokenizer, end_id, width, id_col, text_col), "zstd"), width))
