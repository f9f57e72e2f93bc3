"""A stored inverted index for BM25: postings written once, in blocks with their maxima, and searches that skip blocks.

A segment holds the documents of one addition. Its documents are numbered, ``RANGE`` numbers in a row are a range, and a block is a term's
postings in one range, with the greatest frequency and the least length among them; so blocks of different terms are aligned, none
is larger than a range, and none needs an ordered window over a hot term. Blocks lie in Parquet by bucket of the term's hash, sorted by term within each file; they are written
where they are made, so that neither an addition nor a merge shuffles anything.

A search reads the maxima of its terms' blocks first. Their sum over a query's terms bounds every score in a range. The most promising ranges are
scored, whose k-th best score is a floor; of all others only those whose bound reaches the floor are read. The queries' blocks of a range meet in one
task, which adds up scores and hands on its best ``k``: a block is shuffled once for all queries, a posting never once for each. Results are
those of ``retrieval.bm25``. It is meant for prompts; texts of whole documents as queries are cheaper in the blocks of ``bm25``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.manifest import Conflict, Manifests
from ..storage import written
from .retrieval import CELLS, K1, Asked, B, Best, Block, ranked

#: Documents of a range, buckets of terms, and ranges that are scored to find the floor.
RANGE, BUCKETS, FIRST = 128, 32, 8

BLOCKS = "term string, range long, n int, most int, least int, docs array<int>, tfs array<int>, dls array<int>"
POSTINGS = f"{BLOCKS}, bucket int"
#: Terms whose blocks a task makes at once.
COUNTED = 500_000


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that turns (doc, bag), ascending, into blocks of ``size`` documents. A range that is cut, by a file's splits or at ``COUNTED`` terms, has
    two blocks of a term: counts of documents still add up, and the sum of both maxima is still a bound."""

    def made(docs: np.ndarray, bag: pa.Array) -> Iterator[pa.RecordBatch]:
        dl = pc.fill_null(pc.list_value_length(bag), 0).to_numpy().astype(np.int64)
        coded = bag.flatten().dictionary_encode()
        if not len(coded):
            return
        kinds, row = len(coded.dictionary), np.repeat(np.arange(len(docs)), dl)
        base = docs // size
        number = np.cumsum(np.concatenate([[0], np.diff(base) != 0]))  # of the range
        keys, tf = np.unique((number[row] * kinds + coded.indices.to_numpy()) * len(docs) + row, return_counts=True)
        block, row = np.divmod(keys, len(docs))
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        edge = np.append(first, len(keys)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x.astype(np.int32))) for x in (docs[row] % size, tf, dl[row])]
        sizes = (np.diff(edge), np.maximum.reduceat(tf, first), np.minimum.reduceat(dl[row], first))
        columns = [coded.dictionary.take(pa.array(block[first] % kinds)), pa.array(base[row[first]]), *(pa.array(x.astype(np.int32)) for x in sizes), *lists]
        whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])
        for k in range(0, len(whole), 50_000):
            yield whole.slice(k, 50_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks()
            docs, bag = whole.column(0).to_numpy(), whole.column(1).combine_chunks()
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(bag), 0).to_numpy())])
            ends = np.flatnonzero(np.diff(docs // size)) + 1  # of whole ranges
            low = 0
            while upto[-1] - upto[low] > COUNTED:
                most = max(low + 1, int(np.searchsorted(upto, upto[low] + COUNTED, "right")) - 1)
                fit = ends[(ends > low) & (ends <= most)]
                high = int(fit[-1]) if len(fit) else most
                yield from made(docs[low:high], bag.slice(low, high - low))
                low = high
            held = whole.slice(low).to_batches()
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from made(whole.column(0).to_numpy(), whole.column(1).combine_chunks())

    return task


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def weight(tf: Column | np.ndarray, dl: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """BM25's part of a term: it grows with the frequency and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (mean or 1)))


@dataclass(frozen=True)
class TextIndex:
    """The folder of an index and the versions of its list of segments."""

    spark: SparkSession
    folder: str

    @property
    def manifests(self) -> Manifests:
        return Manifests(self.spark, self.folder)

    def segments(self) -> list[dict]:
        """Name, documents and summed length of each segment in force."""
        version = self.manifests.latest()
        return self.manifests.read(version)["segments"] if version else []

    def add(self, docs: DataFrame) -> None:
        """Indexes documents (path, body) whose paths are not indexed yet, as a segment. Null bodies are empty ones."""
        self._commit(self._segment(docs.select(F.col("path").cast("string").alias("path"), text.terms(F.coalesce("body", F.lit(""))).alias("bag"))), replaced=None)

    def merge(self) -> None:
        """All segments as one: their blocks with ranges that follow on each other; no text is counted again. A segment that is added meanwhile stays beside it."""
        old = self.segments()
        if len(old) < 2:
            return
        docs, blocks, first = [], [], 0
        for s in old:
            part = self.spark.read.schema("path string, doc long").parquet(f"{self.folder}/{s['name']}/docs")
            rows = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/{s['name']}/postings")
            docs.append(part.select("path", (F.col("doc") + first * RANGE).alias("doc")))
            blocks.append(rows.withColumn("range", F.col("range") + first))
            last = part.agg(F.max("doc")).first()[0]
            first += 0 if last is None else last // RANGE + 1
        name = self._named()
        reduce(DataFrame.union, docs).write.parquet(f"{self.folder}/{name}/docs")
        self._deal(reduce(DataFrame.union, blocks), name)
        self._commit({"name": name, "docs": sum(s["docs"] for s in old), "length": sum(s["length"] for s in old)}, replaced={s["name"] for s in old})

    def _named(self) -> str:
        return f"segment-{uuid.uuid4().hex}"

    def _deal(self, blocks: DataFrame, name: str) -> None:
        """Writes blocks by bucket, sorted by term, from the tasks that have them: a file for each task and bucket."""
        columns = [c.split()[0] for c in POSTINGS.split(", ")]
        blocks.select(*columns).sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/postings")

    def _segment(self, bags: DataFrame) -> dict:
        """Writes (path, bag) as a segment that is in no version yet. Documents of a range lie in one task, which makes the range's blocks, so nothing is shuffled."""
        name = self._named()
        numbered = written(bags.withColumn("doc", F.monotonically_increasing_id()))
        numbered.select("path", "doc").write.parquet(f"{self.folder}/{name}/docs")
        rows = numbered.select("doc", "bag").mapInArrow(_blocks(RANGE), BLOCKS)
        self._deal(rows.withColumn("bucket", bucket_of(F.col("term"))), name)
        n, length = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()
        return {"name": name, "docs": n, "length": length}

    def _commit(self, segment: dict, replaced: set[str] | None) -> None:
        """The next version: with the segment, without those it replaces. If another writer was first, on top of that writer's."""
        while True:
            version = self.manifests.latest()
            now = self.manifests.read(version)["segments"] if version else []
            if replaced and not replaced <= {s["name"] for s in now}:
                raise Conflict("the segments were merged by another writer")
            try:
                return self.manifests.commit(version + 1, {"segments": [s for s in now if s["name"] not in (replaced or ())] + [segment]})
            except Conflict:
                continue

    def blocks(self, segments: list[dict], buckets: list[int]) -> DataFrame:
        """The blocks of all segments in some buckets, with the number of their segment."""
        parts = [self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/{s['name']}/postings").where(F.col("bucket").isin(buckets)).withColumn("seg", F.lit(k)) for k, s in enumerate(segments)]
        return reduce(DataFrame.union, parts)

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """(qid, path, score, rank) of the best ``k`` documents for each query (qid, query), as ``retrieval.bm25`` gives them."""
        segments = [s for s in self.segments() if s["docs"]]
        asked = written(queries.select("qid", F.explode(text.terms(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))
        if not segments:
            return asked.select("qid", F.lit("").alias("path"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).where("false")
        n, mean = sum(s["docs"] for s in segments), sum(s["length"] for s in segments) / sum(s["docs"] for s in segments)
        terms = written(asked.select("term").distinct())
        buckets = [r[0] for r in terms.select(bucket_of(F.col("term"))).distinct().collect()]  # BUCKETS at most
        blocks = self.blocks(segments, buckets)
        maxima = written(blocks.select("seg", "term", "range", "n", "most", "least").join(terms, "term"))
        df = maxima.groupBy("term").agg(F.sum("n").alias("df"))
        weights = written(asked.join(df, "term").select("qid", "term", (F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w")))

        bound = F.sum(F.col("w") * weight(F.col("most"), F.col("least"), mean))
        ranges = written(maxima.join(weights, "term").groupBy("qid", "seg", "range").agg(bound.alias("bound")))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "seg", "range")
        best = written(ranges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).select("qid", "seg", "range"))
        weighed = Asked(weights)
        found = written(self._scored(segments, blocks, weighed, best, mean, k))
        floor = found.groupBy("qid").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("hits")).where(F.col("hits") == k).select("qid", "floor")
        # Scores are rounded to six digits, so a bound may be short of one by half a digit.
        more = ranges.join(best, ["qid", "seg", "range"], "left_anti").join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6)).select("qid", "seg", "range")
        rest = self._scored(segments, blocks, weighed, written(more), mean, k)
        return ranked(found.union(rest), k=k)

    def _scored(self, segments: list[dict], blocks: DataFrame, asked: Asked, ranges: DataFrame, mean: float, k: int) -> DataFrame:
        """(qid, path, score): the best ``k`` of each query in given ranges (qid, seg, range)."""
        parts = [self.spark.read.schema("path string, doc long").parquet(f"{self.folder}/{s['name']}/docs").withColumn("seg", F.lit(j)) for j, s in enumerate(segments)]
        named = F.struct((F.col("doc") % RANGE).cast("int").alias("doc"), "path")
        docs, out = reduce(DataFrame.union, parts).select("seg", F.floor(F.col("doc") / RANGE).alias("range"), named.alias("named")), None
        columns, place = ["term", "docs", "tfs", "dls"], ["seg", "range"]
        for block in asked.blocks():
            held, numbers = self.spark.sparkContext.broadcast(block), F.col("n").between(block.first, block.first + block.queries - 1)
            who = written(ranges.join(asked.numbers.where(numbers), "qid").groupBy(*place).agg(F.collect_list("n").alias("who")))  # a block's queries at most
            names = docs.join(who.select(*place), place, "left_semi").groupBy(*place).agg(F.collect_list("named").alias("names"))  # RANGE at most
            terms = written(asked.rows.where(numbers).select("term").distinct())
            met = blocks.select(*place, *columns).join(terms, "term", "left_semi").join(who.select(*place), place, "left_semi")
            rows = who.join(names, place).unionByName(met, allowMissingColumns=True).select(*place, *columns, "who", "names")
            dealt = rows.repartition(*place).sortWithinPartitions(*place, F.col("term").asc_nulls_first())
            part = dealt.mapInArrow(_best(held, mean, k), "n long, path string, score double")
            if asked.several:
                part = written(ranked(part, "n", k).drop("rank"))
                held.unpersist()
            out = part if out is None else out.union(part)
        if out is None:
            out = self.spark.createDataFrame([], "n long, path string, score double")
        return ranked(out.join(asked.numbers, "n").select("qid", "path", "score"), k=k).drop("rank")


def _best(held: Broadcast, mean: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that scores ranges one after another. Of each range the first row (seg, range, term, docs, tfs, dls, who, names) has no term, but the
    numbers of the queries that want it and the names of its documents; its blocks follow, by term."""

    def scored(block: Block, rows: pa.Table, best: Best) -> None:
        head, rows = rows.slice(0, 1), rows.slice(1).combine_chunks()
        term = pc.index_in(rows["term"].combine_chunks(), value_set=block.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, tf, dl = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("docs", "tfs", "dls"))
        at = np.repeat(term, pc.list_value_length(rows["docs"]).to_numpy().astype(np.int64))
        part, times = weight(tf, dl, mean), block.start[at + 1] - block.start[at]
        names, other = head["names"][0].as_py(), np.ones(block.queries, bool)
        size = 1 + max(x["doc"] for x in names)
        upto, value, low = np.cumsum(times), np.zeros(size * block.queries), 0
        while low < len(doc):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] - times[low] + CELLS, "right")))
            own = times[low:high]
            spread = np.repeat(block.start[at[low:high]] - np.cumsum(own) + own, own) + np.arange(own.sum())
            value += np.bincount(np.repeat(doc[low:high] * block.queries, own) + block.query[spread], np.repeat(part[low:high], own) * block.weight[spread], minlength=len(value))
            low = high
        other[np.array(head["who"][0].as_py()) - block.first] = False
        value = np.round(value.reshape(size, block.queries)[[x["doc"] for x in names]], 6) + 0.0
        best.take(np.where((value > 0) & ~other[None, :], value, -np.inf), np.array([x["path"] for x in names], dtype=object))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rest = held.value, []
        best = Best(block.queries, k)
        for batch in batches:
            heads = np.append(np.flatnonzero(pc.is_null(batch.column(2)).to_numpy(zero_copy_only=False)), len(batch))
            rest.append(batch.slice(0, heads[0]))
            for first, last in zip(heads, heads[1:]):
                if sum(map(len, rest)):
                    scored(block, pa.Table.from_batches(rest), best)
                rest = [batch.slice(first, last - first)]
        if sum(map(len, rest)):
            scored(block, pa.Table.from_batches(rest), best)
        yield best.batch(block.first)

    return task
