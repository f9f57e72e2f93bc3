"""Incremental reads of growing folders, and idempotent appends from streams.

Spark's checkpoint keeps what has been read, in place of byte offsets; it lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and held keys that a task of ``append_new`` gets on average.
PART_ROWS = 250_000


def files(spark: SparkSession, path: str, schema: str, form: str = "parquet", per_batch: int = 100) -> DataFrame:
    """A stream of the files in a folder, old and new."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(path)


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Handles all that is there now, batch by batch, and stops. A batch may come twice after a failure."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_new(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A handler that adds the rows whose key the target does not hold: a batch that comes twice changes nothing.

    Rows and held keys are dealt by key to as many tasks as there are ``PART_ROWS`` of them, before anything is sorted, so a task
    sorts about so many, whatever the sizes of batch, files and target. Rows of one key lie in one task. The batch is read once more, to be counted.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, rows, held = batch.sparkSession, batch.count(), None
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(target)
        if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
            held = spark.read.parquet(target).select(key)
            rows += held.count()
        parts = -(-rows // PART_ROWS) or 1
        new = batch.repartition(parts, key).dropDuplicates([key])
        if held is not None:
            new = new.join(held.repartition(parts, key), key, "left_anti").select(*batch.columns)
        new.write.mode("append").parquet(target)

    return handle


def append_once(target: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own, ``batch=N``: one that comes twice takes its own place, and what is there is never read.

    Meant behind ``deduplicated``, whose state knows the keys already. Readers find the number as a column, ``batch``; an empty batch writes nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return handle


def deduplicated(stream: DataFrame, key: str, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Drops rows whose key was there before; the first to arrive stays, and null is a key as any other.

    Keys are kept by the state store, dealt by their hash, so a batch touches its own keys and rereads no table. With ``time``, keys are
    forgotten when the watermark has passed them by ``late``, which bounds the state: rows later than that are dropped, and repeats are found
    within it. Without it the result is exact for good and the state has a row for each key; sessions whose keys outgrow executors'
    memory name RocksDB as ``spark.sql.streaming.stateStore.providerClass``.
    """
    return stream.dropDuplicates([key]) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, by: list[str]) -> DataFrame:
    """Counts for each tumbling window, for batches and streams; in a stream, rows later than the watermark are dropped."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def session_counts(rows: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    """Sessions of each key, parted by a gap, with their counts."""
    rows = rows.withWatermark(time, gap) if rows.isStreaming else rows
    return rows.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), "n")
