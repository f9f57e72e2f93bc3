"""An inverted-file index of vectors: cells by k-means, Parquet partitioned by cell, and searches that read the cells they need.

Cells are fitted to a bounded sample; every vector is indexed. A search probes the cells whose centres are nearest to a query, and
what an executor holds are the centres and a block of queries. The exact search goes on from there: vectors of a cell are within its widest
angle of the centre, so cells that cannot hold a better hit are left out, and all others are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .ordered import row_numbers
from .retrieval import BLOCK, ROWS, Best, ranked

#: Vectors to which the cells are fitted, at most: those whose paths hash lowest. Rows of a cell in one file, about.
SAMPLE, FILE_ROWS = 20_000, 1_000_000
_ROUNDS = 12


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as unit rows."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres by spherical k-means, begun at rows spread evenly over the sample; cells that run empty are dropped."""
    rows = unit(sample)
    rows = rows[np.lexsort(rows.T[::-1])]  # in an order that depends on the vectors alone
    found = np.unique(rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)], axis=0)
    for _ in range(_ROUNDS):
        nearest = (rows @ found.T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        found = unit(np.add.reduceat(rows[order], first, axis=0))
    return found


@dataclass(frozen=True)
class Index:
    """The folder of an index: tables ``cells`` (cell, centre) and ``vectors`` (path, embedding, angle, cell), the last by cell. ``kind`` is
    the type of its embeddings."""

    spark: SparkSession
    folder: str
    kind: str = "array<float>"

    def centre_rows(self) -> np.ndarray:
        """All centres, by cell. There are as many as were asked for when the index was built, whatever the vectors."""
        rows = self.spark.read.parquet(f"{self.folder}/cells").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows], float) if rows else np.zeros((0, 0))

    def vectors(self) -> DataFrame:
        schema = f"path string, embedding {self.kind}, angle double, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/vectors")

    def add(self, vectors: DataFrame) -> None:
        """Indexes (path, embedding). Rows without a vector are no hits and are left out. A hot cell is several files."""
        held = self.spark.sparkContext.broadcast(self.centre_rows())

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = matrix(batch.column(1))
                near = rows @ held.value.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(rows)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle), pa.array(cell.astype(np.int32))], names=["path", "embedding", "angle", "cell"])

        good = vectors.where("embedding is not null and size(embedding) > 0").select(F.col("path").cast("string").alias("path"), F.col("embedding").cast(self.kind).alias("embedding"))
        placed = written(good.mapInArrow(task, f"path string, embedding {self.kind}, angle double, cell int"))
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("files"))
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("__file", F.pmod(F.xxhash64("path"), F.col("files")))
        dealt.repartition("cell", "__file").drop("__file", "files").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/vectors")

    def bounds(self) -> np.ndarray:
        """The widest angle of each cell, -1 where it is empty; a row a cell."""
        out = np.full(len(self.centre_rows()), -1.0)
        for r in self.vectors().groupBy("cell").agg(F.max("angle").alias("angle")).collect():
            out[r["cell"]] = r["angle"]
        return out

    def search(self, queries: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
        """(qid, path, score, rank): the nearest ``k`` to each query (qid, embedding) by cosine, of its ``probes`` nearest cells, or of all if ``exact``."""
        centre, widest = self.centre_rows(), self.bounds()
        full = np.flatnonzero(widest >= 0)
        numbered = written(row_numbers(queries.where("embedding is not null and size(embedding) > 0").select("qid", "embedding"), ["qid"]))
        last, out = numbered.agg(F.max("n")).first()[0] or 0, self.spark.createDataFrame([], "n long, path string, score double")
        for first in range(1, last + 1, BLOCK):
            rows = numbered.where(F.col("n").between(first, first + BLOCK - 1)).orderBy("n").collect()
            asked = unit(np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1))
            near = asked @ centre[full].T if len(full) else np.zeros((len(asked), 0))
            take = min(probes, len(full))
            wanted = np.zeros(near.shape, bool)
            if take:
                np.put_along_axis(wanted, np.argpartition(-near, take - 1, axis=1)[:, :take], True, axis=1)
            found = written(self._probe(asked, full, wanted, k, first))
            if exact and not wanted.all():
                # No vector of a cell is nearer than the query is to the cell's rim.
                best = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - widest[full]))
                floor = np.full(len(asked), -np.inf)
                for r in found.groupBy("n").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("hits")).collect():  # a row a query of the block
                    if r["hits"] == k:
                        floor[r["n"] - first] = r["least"]
                more = ~wanted & (best >= floor[:, None] - 1e-6)
                found = written(ranked(found.union(self._probe(asked, full, more, k, first)), "n", k).drop("rank"))
            out = out.union(found)
        return ranked(out.join(numbered.select("n", "qid"), "n").select("qid", "path", "score"), k=k)

    def probes_for(self, k: int, recall: float = 0.95, sample: int = 200) -> int:
        """The fewest probes that find the share ``recall`` of the exact ``k`` nearest of ``sample`` indexed vectors (those whose paths hash lowest)."""
        place = F.xxhash64("path")
        asked = self.vectors().orderBy(place, "path").limit(sample).select(F.col("path").alias("qid"), "embedding")
        rows = {r["qid"]: r["embedding"] for r in asked.collect()}
        hits = self.search(asked, k, probes=1, exact=True).select("qid", "path").join(self.vectors().select("path", "cell"), "path").select("qid", "cell").collect()  # k rows a query of the sample
        if not hits:
            return 1
        near = unit(np.array([rows[h["qid"]] for h in hits], float)) @ self.centre_rows().T
        own = near[np.arange(len(hits)), [h["cell"] for h in hits]]
        return int(np.sort((near > own[:, None]).sum(axis=1) + 1)[int(np.ceil(recall * len(hits))) - 1])

    def _probe(self, asked: np.ndarray, cells: np.ndarray, wanted: np.ndarray, k: int, first: int) -> DataFrame:
        """(n, path, score): the best ``k`` of each query in the cells that it wants. Only cells that some query wants are read."""
        read = cells[wanted.any(axis=0)].tolist()
        held = self.spark.sparkContext.broadcast((asked, {int(c): np.flatnonzero(wanted[:, j]) for j, c in enumerate(cells)}))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, of_cell = held.value
            best = Best(len(asked), k)
            for batch in batches:
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell):
                    some = batch.filter(pa.array(cell == c))
                    rows, paths, mine = matrix(some.column(1)), np.array(some.column(0).to_pylist(), dtype=object), of_cell[int(c)]
                    for low in range(0, len(rows), ROWS):
                        scores = np.full((len(rows[low : low + ROWS]), len(asked)), -np.inf)
                        scores[:, mine] = np.round(rows[low : low + ROWS] @ asked[mine].T, 6) + 0.0
                        best.take(scores, paths[low : low + ROWS])
            yield best.batch(first)

        parts = self.vectors().where(F.col("cell").isin(read)).select("path", "embedding", "cell").mapInArrow(task, "n long, path string, score double")
        return ranked(parts, "n", k).drop("rank")


def build(vectors: DataFrame, folder: str, cells: int, sample: int = SAMPLE) -> Index:
    """An index of (path, embedding) in ``folder``, with ``cells`` cells at most, fitted to at most ``sample`` vectors."""
    spark = vectors.sparkSession
    good = vectors.where("embedding is not null and size(embedding) > 0")
    place, space, total = F.pmod(F.xxhash64(F.col("path").cast("string")), F.lit(1 << 40)), 1 << 40, good.count()
    near = good.where(place < min(space, int(space * 2.0 * sample / max(1, total)) + 1))  # so that little is sorted
    rows = near.orderBy(place, F.col("path").cast("string")).limit(sample).select("embedding").collect()
    found = centres(np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1), cells) if rows else np.zeros((0, 0))
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/cells")
    index = Index(spark, folder, good.schema["embedding"].dataType.simpleString())
    if rows:
        index.add(good)
    else:
        spark.createDataFrame([], f"path string, embedding {index.kind}, angle double, cell int").write.parquet(f"{folder}/vectors")
    return index
