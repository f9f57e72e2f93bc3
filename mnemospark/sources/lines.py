"""Lines of growing files as a data source, for batches and streams: ``spark.read.format("tailed_lines")`` and ``spark.readStream``.

A stream's offset is a byte position in each file, so only bytes that came since are read, and a line that is half
written waits for its end. A line belongs to the range of bytes that holds its newline. So ranges may be cut anywhere: large files are
read in parallel, and planning looks at the files' sizes and at none of their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Bytes that one task reads; bytes that it asks for at once, and of lines that it hands on at once.
SPLIT, CHUNK, OUT = 64 << 20, 1 << 20, 1 << 20
NAME = "tailed_lines"
SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string())])


@dataclass
class Range(InputPartition):
    """Bytes from ``start`` up to ``stop`` of a file."""

    file: str
    start: int
    stop: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there: local, HDFS, or an object store by its scheme."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def sizes(path: str, pattern: str) -> dict[str, int]:
    """The files below a folder (or the file itself) whose name matches, with their sizes; hidden ones and those of running commits are none."""
    store, root = opened(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return {root: store.get_file_info(root).size}
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    shown = lambda f: not any(part[:1] in ("_", ".") for part in f.path[len(root) :].strip("/").split("/"))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern) and shown(f)}


def head(stream: pa.NativeFile, start: int) -> bytes:
    """The bytes before ``start`` that belong to the line there."""
    parts, at = [], start
    while at > 0:
        low = max(0, at - CHUNK)
        stream.seek(low)
        part = stream.read(at - low)
        cut = part.rfind(b"\n") + 1
        parts.append(part[cut:])
        if cut:
            break
        at = low
    return b"".join(reversed(parts))


def lines(stream: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of all lines whose newline is in the range; of other lines at most the range's bytes are held."""
    held, begin, position, first = bytearray(), start, start, True
    while position < stop:
        stream.seek(position)
        chunk = stream.read(min(CHUNK, stop - position))
        if not chunk:
            break
        at = 0
        while (end := chunk.find(b"\n", at)) >= 0:
            held += chunk[at:end]
            if first:
                before, first = head(stream, start), False
                begin, held = start - len(before), bytearray(before) + held
            yield begin, bytes(held)
            held.clear()
            at = end + 1
            begin = position + at
        held += chunk[at:]
        position += len(chunk)


class _Ranges:
    """What batches and streams share."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("tailed_lines needs a path")
        self.path, self.pattern, self.split = options["path"], options.get("pattern", "*"), int(options.get("splitBytes", SPLIT))

    def ranges(self, before: dict[str, int], now: dict[str, int]) -> list[Range]:
        return [Range(file, low, min(low + self.split, size)) for file, size in sorted(now.items()) for low in range(before.get(file, 0), size, self.split)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's own, where there is no file
            return
        store = opened(self.path)[0]
        rows, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)
        with store.open_input_file(partition.file) as stream:
            for begin, line in lines(stream, partition.start, partition.stop):
                rows.append((partition.file, begin, line.removesuffix(b"\r").decode("utf-8", "replace")))
                size += len(line) + 64
                if size >= OUT:
                    yield pack()
                    rows, size = [], 0
        if rows:
            yield pack()


class _Batch(_Ranges, DataSourceReader):
    """Filters on whole file names leave files out before they are read."""

    wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[Range]:
        return self.ranges({}, {f: n for f, n in sizes(self.path, self.pattern).items() if self.wanted is None or f in self.wanted})


class _Stream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return sizes(self.path, self.pattern)

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return self.ranges(start, end)


class TailedLines(DataSource):
    """(file, offset, line) of append-only files; options: path, pattern of names (``*``), splitBytes.

    Blank lines are lines; the last line of a file counts once its newline is there, in batches as in streams. A file that has shrunk
    gives nothing, and a stream goes on at its new end. Bytes that are no UTF-8 become replacement characters; a ``\\r`` before the newline is
    no part of the line. (file, offset) names a line for good, which makes appends repeatable. Offsets hold a number for each file of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it hand filters to Python sources, which Spark does not by itself."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TailedLines)


def read(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(path=path, **options).load()


def stream(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(path=path, **options).load()
