"""A keyed table that writes: upserts and prunes by copy on write, in versions.

Rows lie in Parquet by bucket of their key's hash. A change rewrites the buckets that it touches, and no others, under a name of its
own, and a manifest then names the files of every bucket; what is not named is in no version, whether a task was run twice or a writer died.
Rows that are there already, column by column, are no change: a run that changes nothing writes nothing.

New rows are dealt by bucket and written once; where a bucket had no rows, or keeps none of them, what was written is its new content as it lies.

Two writers do not lose each other's rows: the one whose version is taken works out its change anew, on the version of the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written
from .manifest import Conflict, Manifests

BUCKETS = 64
#: Parts in which a bucket is dealt, and how its files are packed: keys are digests often, which Snappy leaves as they are.
PARTS, PACKED = 4, "zstd"


@dataclass(frozen=True)
class Store:
    """The table in ``folder``, with one row for each value of ``key``. ``schema`` is that of its rows."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    key: str
    buckets: int = BUCKETS

    @property
    def manifests(self) -> Manifests:
        return Manifests(self.spark, self.folder)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("__bucket")

    def _files(self, version: int) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        return self.manifests.read(version)["buckets"] if version else {}

    def _read(self, files: dict[str, str], only: list[int] | None = None) -> DataFrame:
        """The rows of all or some buckets: the folders that hold them are few, and a bucket is a partition of its folder."""
        by_folder: dict[str, list[int]] = {}
        for bucket, name in files.items():
            if only is None or int(bucket) in only:
                by_folder.setdefault(name, []).append(int(bucket))
        out = self.spark.createDataFrame([], self.schema)
        for name, some in sorted(by_folder.items()):
            rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(f"{self.folder}/{name}")
            out = out.union(rows.where(F.col("__bucket").isin(some)).drop("__bucket"))
        return out

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the newest. Older versions can be read as long as their files are there."""
        return self._read(self._files(self.manifests.latest() if version is None else version))

    def upsert(self, rows: DataFrame) -> dict[str, int]:
        """Adds rows, or puts them in place of those of equal key; of rows of one key in ``rows`` the greatest stays."""
        return self._put(rows, prune=False)

    def sync(self, rows: DataFrame) -> dict[str, int]:
        """Makes the table equal to ``rows``: upserts them, and prunes the keys that they do not hold."""
        return self._put(rows, prune=True)

    def delete(self, keys: DataFrame) -> dict[str, int]:
        """Prunes the rows whose keys are in the column ``key`` of ``keys``."""
        gone = written(keys.select(F.col(f"`{self.key}`").cast(self.schema[self.key].dataType).alias(self.key)).distinct())

        def change(files: dict[str, str]) -> tuple[DataFrame, Callable[[list[int]], DataFrame]]:
            kind = F.when(F.col("__gone"), "deleted").otherwise("kept").alias("kind")
            kinds = self._read(files).select(self.key).join(gone.withColumn("__gone", F.lit(True)), self.key, "left").select(self._bucket(), kind)
            return kinds, lambda touched: self._read(files, touched).join(gone, self.key, "left_anti").select(*self.schema.names)

        return self._commit(change)[0]

    def _put(self, rows: DataFrame, prune: bool) -> dict[str, int]:
        name = f"data-{uuid.uuid4().hex}"
        self._one_each(rows).write.partitionBy("__bucket").option("compression", PACKED).parquet(f"{self.folder}/{name}")
        own = {b: name for b in self._sizes(name)}

        def digest(t: DataFrame, name: str) -> DataFrame:
            parts = [x for c in self.schema.names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
            return t.select(self.key, F.struct(F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)).alias(name))

        def change(files: dict[str, str]) -> tuple[DataFrame, Callable[[list[int]], DataFrame]]:
            met = files if prune else {b: f for b, f in files.items() if b in own}
            both = digest(self._read(met), "__old").join(digest(self._read({b: name for b in own if b in met}), "__new"), self.key, "full_outer")
            missing = F.col("__new").isNull()
            kind = F.when(missing, "deleted" if prune else "kept").when(F.col("__old").isNull() | (F.col("__old") != F.col("__new")), "written").otherwise("kept").alias("kind")

            def content(touched: list[int]) -> DataFrame:
                mine = self._read(own, touched)
                return mine.unionByName(self._read(files, touched).join(mine.select(self.key), self.key, "left_anti").select(*self.schema.names))

            return both.select(self._bucket(), kind), content

        adopted = False
        try:
            count, adopted = self._commit(change, name, prune)
            return count
        finally:
            if not adopted:
                self._remove(name)

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """Rows of the table's columns and types, one a key, with their bucket, by which they are dealt. A null key is no key."""
        typed = rows.where(F.col(f"`{self.key}`").isNotNull()).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        part = F.pmod(F.xxhash64(F.lit(2), F.col(f"`{self.key}`")), F.lit(PARTS)).cast("int").alias("__part")
        dealt, by = typed.select("*", self._bucket(), part).repartition("__bucket", "__part"), ["__bucket", "__part", self.key]
        rest = [f"`{c}`" for c in self.schema.names if c != self.key]
        if not rest:
            return dealt.groupBy(*by).agg(F.count(F.lit(1))).select(*self.schema.names, "__bucket")
        out = dealt.groupBy(*by).agg(F.max(F.struct(*rest)).alias("__rest"))
        return out.select(*[F.col(c) if c == self.key else F.col(f"__rest.{c}").alias(c) for c in self.schema.names], "__bucket")

    def _sizes(self, name: str) -> dict[str, int]:
        """The buckets of a folder, and their rows."""
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(f"{self.folder}/{name}")
        return {str(b): n for b, n in rows.groupBy("__bucket").count().collect()}  # as many as buckets

    def _commit(self, change: Callable[[dict[str, str]], tuple[DataFrame, Callable[[list[int]], DataFrame]]], new: str | None = None, whole: bool = False) -> tuple[dict[str, int], bool]:
        """Rows written, deleted and left of the buckets that were met, and whether the folder ``new`` is in the version. ``change`` gives, on the files of a version,
        what happens to each row (__bucket, kind) and the new content of touched buckets; it is worked out anew on the newest version whenever another writer was
        first. Buckets that had no rows, or all that are touched if ``new`` has the ``whole`` table, lie in ``new`` already."""
        own = self._sizes(new) if new else {}
        while True:
            version = self.manifests.latest()
            files = self._files(version)
            kinds, content = change(files)
            changes = kinds.groupBy("__bucket", "kind").count().collect() if files else []  # three rows a bucket at most
            count = {k: sum(r["count"] for r in changes if r["kind"] == k) for k in ("written", "deleted", "kept")}
            touched = sorted({r["__bucket"] for r in changes if r["kind"] != "kept"})
            fresh = {b: n for b, n in own.items() if b not in files}
            count["written"] += sum(fresh.values())
            if not touched and not fresh:
                return count, False
            now = {b: f for b, f in files.items() if int(b) not in touched} | {b: new for b in fresh}
            if touched and whole:
                now |= {b: new for b in own if int(b) in touched}
            elif touched:
                name = f"data-{uuid.uuid4().hex}"
                content(touched).select("*", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").option("compression", PACKED).parquet(f"{self.folder}/{name}")
                now |= {b: name for b in self._sizes(name)}
            try:
                self.manifests.commit(version + 1, {"buckets": now})
                return count, new in now.values()
            except Conflict:
                continue

    def _remove(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the data that none of the newest ``keep`` versions names, and returns its folders. No writer may be at work meanwhile."""
        latest = self.manifests.latest()
        named = {f for v in range(max(1, latest - keep + 1), latest + 1) for f in self._files(v).values()}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        stale = [s.getPath() for s in store.listStatus(place) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named]
        return [p.getName() for p in stale if store.delete(p, True)]
