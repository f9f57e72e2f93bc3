"""Tables that cut lineage, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group, which a task holds while it writes.
BLOCK = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the application ends.

    It lies in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process, as in tests,
    a local temporary folder takes its place; executors of a cluster would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set("spark.checkpoint.dir", base)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/mnemospark-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return store.makeQualified(path).toString()


def written(df: DataFrame, compression: str = "snappy", block: int = BLOCK) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in row groups of ``block`` bytes: its lineage is cut and its size known.

    The table lies there until the application ends, since tables made of it may still be read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table"
    df.write.option("compression", compression).option("parquet.block.size", block).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
