"""Ranked retrieval: BM25, dense top-k, rank fusion, review policy, budgets, quality.

Queries come as a table, so that evaluating many is one job. They are asked whole, in blocks of a bounded size: a task
scores its documents against a block and hands on its best, so that what is shuffled is k rows a query and task, and
never a row for each document and query. Scores are rounded to six digits before
ranking and ties go by path, which makes ranks independent of the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..storage import written
from .ordered import row_numbers

#: BM25's k1 and b, and the constant of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Queries, and (query, term) pairs, that a task holds at once; documents that it scores at once.
BLOCK, BLOCK_TERMS, ROWS = 4096, 1_000_000, 256
#: Terms of documents that are looked up at once, and (document, query, term) parts of scores that a task holds at once.
LOOKED_UP, CELLS = 500_000, 131_072
#: Terms of a block that are added up by a matrix product: the most frequent ones, in blocks of so many queries, of those that one query in ``FREQUENT`` has.
PRODUCT_TERMS, PRODUCT_QUERIES, FREQUENT = 512, 64, 16


def postings(docs: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(path, term, tf, dl): a row for each document and term."""
    bag = docs.select(F.col(path).alias("path"), text.terms(F.col(body)).alias("bag"))
    return bag.select("path", F.size("bag").cast("long").alias("dl"), F.explode("bag").alias("term")).groupBy("path", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def ranked(scored: DataFrame, group: str = "qid", k: int | None = None) -> DataFrame:
    """Ranks (group, path, score) within the group, best first, and keeps ``k``."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "path")).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


class Best:
    """The best ``k`` (score, path) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[float, str]]] = [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def take(self, scores: np.ndarray, paths: np.ndarray) -> None:
        """Scores (document, query); those of -inf are no hits."""
        place, most = np.argsort(np.argsort(paths, kind="stable"), kind="stable"), scores.max(axis=0, initial=-np.inf)
        active = np.flatnonzero((most >= self.least) & (most > -np.inf))
        columns = np.ascontiguousarray(scores[:, active].T)
        row, at = np.nonzero((columns >= self.least[active, None]) & (columns > -np.inf))
        edges = np.searchsorted(row, np.arange(len(active) + 1))
        for n, q in enumerate(active):
            column, some = columns[n], at[edges[n] : edges[n + 1]]
            if len(some) > self.k:
                some = some[column[some] >= np.partition(column[some], -self.k)[-self.k]]
                some = some[np.lexsort((place[some], -column[some]))[: self.k]]
            rows = self.rows[q] = sorted(self.rows[q] + list(zip((-column[some]).tolist(), paths[some])))[: self.k]
            if len(rows) == self.k:
                self.least[q] = -rows[-1][0]

    def batch(self, first: int) -> pa.RecordBatch:
        flat = [(first + q, path, -score) for q, rows in enumerate(self.rows) for score, path in rows]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.string(), pa.float64()))], names=["n", "path", "score"])


def bags(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(path, bag, and other columns) of documents (path, body), tokenised once and written."""
    return written(docs.select(F.col("path").cast("string").alias("path"), text.terms(F.col("body")).alias("bag"), *(more or [])))


class Block:
    """Some whole queries, numbered from ``first`` on, as arrays: what a task holds of them. Rows are (number, term, weight)."""

    def __init__(self, rows: pa.Table, first: int, queries: int):
        self.first, self.queries = first, queries
        terms = pc.unique(rows["term"])
        self.terms = terms.take(pc.array_sort_indices(terms))
        term = pc.index_in(rows["term"].combine_chunks(), value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((rows["n"].to_numpy(), term))
        self.query = (rows["n"].to_numpy() - first)[order].astype(np.int32)
        self.weight = rows["w"].to_numpy()[order].astype(float)
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.sizes = np.bincount(self.query, minlength=queries)
        self.product = None

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """(column of each term, or -1; matrix) of terms so frequent that a product with their weights costs less than a part of a score for each of their queries."""
        if self.product is None:  # made by the worker that scores
            times = np.diff(self.start)
            some = np.flatnonzero(times * FREQUENT > self.queries) if self.queries >= PRODUCT_QUERIES else np.zeros(0, np.int64)
            some = np.sort(some[np.argsort(-times[some], kind="stable")[:PRODUCT_TERMS]])
            column, matrix = np.full(len(self.terms), -1), np.zeros((len(some), self.queries))
            column[some] = np.arange(len(some))
            for k, t in enumerate(some):
                np.add.at(matrix[k], self.query[self.start[t] : self.start[t + 1]], self.weight[self.start[t] : self.start[t + 1]])
            self.product = column, matrix
        return self.product

    def sums(self, bag: pa.Array, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, sums) of some bags at once: for each query the sum of weight times ``part``, which takes the counts of terms in bags and the bags' sizes."""
        size = pc.fill_null(pc.list_value_length(bag), 0).to_numpy().astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        first = 0
        while first < len(bag):
            many = int(np.searchsorted(upto, upto[first] + LOOKED_UP, "right")) - 1 - first
            last = min(len(bag), first + max(ROWS, many // ROWS * ROWS))  # whole steps, so that columns of one batch go in step
            found = pc.fill_null(pc.index_in(bag.slice(first, last - first).flatten(), value_set=self.terms), -1).to_numpy()
            for low in range(first, last, ROWS):
                high = min(low + ROWS, last)
                yield low, high, self._sums(found[upto[low] - upto[first] : upto[high] - upto[first]], size[low:high], part)
            first = last

    def _sums(self, found: np.ndarray, size: np.ndarray, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sums of documents of given sizes, of whose terms ``found`` are the places; one document has no more parts than the block has rows."""
        doc = np.repeat(np.arange(len(size)), size)
        pairs, tf = np.unique(doc[found >= 0] * len(self.terms) + found[found >= 0], return_counts=True)
        doc, at = np.divmod(pairs, max(1, len(self.terms)))
        parts, (column, matrix) = part(tf, size[doc]), self.frequent()
        out, low = np.zeros((len(size), self.queries)), 0
        if len(matrix) and len(at):
            often = column[at] >= 0
            held = np.zeros((len(size), len(matrix)))
            held[doc[often], column[at[often]]] = parts[often]
            out = held @ matrix
            doc, at, parts = doc[~often], at[~often], parts[~often]
        many = self.start[at + 1] - self.start[at]
        ends = np.searchsorted(doc, np.arange(len(size) + 1))
        cells = np.concatenate([[0], np.cumsum(many)])[ends]
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(cells, cells[low] + CELLS, "right")) - 1)
            a, b = ends[low], ends[high]
            times = many[a:b]
            upto = np.cumsum(times)
            spread = np.repeat(self.start[at[a:b]] - upto + times, times) + np.arange(upto[-1] if len(upto) else 0)
            cell = np.repeat((doc[a:b] - low) * self.queries, times) + self.query[spread]
            out[low:high] += np.bincount(cell, np.repeat(parts[a:b], times) * self.weight[spread], minlength=(high - low) * self.queries).reshape(high - low, self.queries)
            low = high
        return out

    def bm25(self, bag: pa.Array, mean: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, scores) of some documents at once; -inf where no term is shared."""
        for low, high, value in self.sums(bag, lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (mean or 1)))):
            value = np.round(value, 6) + 0.0
            yield low, high, np.where(value > 0, value, -np.inf)


class Asked:
    """Terms of queries (qid, term, weight), numbered, and cut into blocks of whole queries.

    A block holds at most ``BLOCK`` queries, and ``BLOCK_TERMS`` rows or one query. It is cut by the running number of
    terms, so that a long query makes its own block small and no other.
    """

    def __init__(self, terms: DataFrame):
        self.numbers = written(row_numbers(terms.select("qid").distinct(), ["qid"]))
        rows = terms.join(self.numbers, "qid").select("n", "term", "w")
        self.rows = written(rows.repartitionByRange("n").sortWithinPartitions("n"))
        self.last, self.total = self.rows.agg(F.max("n"), F.count(F.lit(1))).first()
        self.several = bool(self.last) and (self.last > BLOCK or self.total > BLOCK_TERMS)

    def blocks(self) -> Iterator[Block]:
        first = 1
        while first <= (self.last or 0):
            some = self.rows.where(F.col("n").between(first, first + BLOCK - 1))
            sizes = np.zeros(min(BLOCK, self.last - first + 1), np.int64)
            for n, size in some.groupBy("n").count().collect():  # a row a query of the block
                sizes[n - first] = size
            number = max(1, int(np.searchsorted(np.cumsum(sizes), BLOCK_TERMS, "right")))
            yield Block(some.where(F.col("n") < first + number).toArrow(), first, number)
            first += number


def weighed(docs: DataFrame, queries: DataFrame) -> tuple[Asked, float]:
    """The terms of queries (qid, query) with their BM25 weights over documents' bags, and the mean size of a bag."""
    asked = queries.select("qid", F.explode(text.terms(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select("term").distinct()
    df = written(docs.select(F.explode(F.array_distinct("bag")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size("bag"))).first()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Asked(asked.join(df, "term").select("qid", "term", (F.col("qtf") * idf).alias("w"))), mean


def best_of_blocks(rows: DataFrame, asked: Asked, k: int, scores: Callable[[Block, pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """(qid, path, score, rank) of the best ``k`` rows for each query. ``scores`` gives those of some rows of a batch, whose first column is the path."""
    spark, out = rows.sparkSession, None
    for block in asked.blocks():
        held = spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            best = Best(block.queries, k)
            for batch in batches:
                paths = np.array(batch.column(0).to_pylist(), dtype=object)
                for low, high, value in scores(block, batch):
                    best.take(value, paths[low:high])
            yield best.batch(block.first)

        part = rows.mapInArrow(task, "n long, path string, score double")
        if asked.several:  # one block's queries go before the next one's come
            part = written(ranked(part, "n", k).drop("rank"))
            held.unpersist()
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], "n long, path string, score double")
    return ranked(out.join(asked.numbers, "n").select("qid", "path", "score"), k=k)


def overlap(docs: DataFrame, queries: DataFrame, k: int, jaccard: bool = False, least: float = 0.0, boost: float = 0.0, most: float = 0.0) -> DataFrame:
    """(qid, path, score, rank) of the best ``k`` documents (path, words, and tags if there is a boost) for each query (qid, words), by words in common.

    Words are sets. The score is the number of common words or, with ``jaccard``, its share of both sets' union, plus ``boost`` for each of
    the document's tags among the query's words, ``most`` at the utmost. Documents without a common word, or of a score below ``least``, are no hits.
    Null or empty sets have none. Frequent words cost no rows: sets are met in blocks of queries, and a task hands on its best.
    """
    tags = ["tags"] if boost else []
    asked = Asked(queries.select("qid", F.explode(F.array_distinct("words")).alias("term"), F.lit(1.0).alias("w")))
    rows = docs.select(F.col("path").cast("string").alias("path"), F.array_distinct("words").alias("words"), *[F.array_distinct(t).alias(t) for t in tags])

    def scores(block: Block, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        one = lambda tf, size: np.ones(len(tf))
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        marks = block.sums(batch.column(2), one) if boost else None
        for low, high, common in block.sums(batch.column(1), one):
            value = common / np.maximum(sizes[low:high, None] + block.sizes[None, :] - common, 1) if jaccard else common
            if boost:
                value = value + np.minimum(most, boost * next(marks)[2])
            value = np.floor(value * 1e6 + 0.5) / 1e6  # halves go up, as SQL rounds them: shares such as 1/128 have them
            yield low, high, np.where((common > 0) & (value >= least), value, -np.inf)

    return best_of_blocks(rows, asked, k, scores)


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, path, score, rank) of the best ``k`` documents (path, body) for each query (qid, query), by all its terms.

    Document lengths and frequencies are aggregated over all documents, which are tokenised once.
    """
    return bm25_of(bags(docs), queries, k)


def bm25_of(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``bm25`` of documents as bags (path, bag), which are read several times."""
    asked, mean = weighed(texts, queries)
    return best_of_blocks(texts.select("path", "bag"), asked, k, lambda block, batch: block.bm25(batch.column(1), mean))


def standing(docs: DataFrame, queries: DataFrame, support: DataFrame, size: Column) -> DataFrame:
    """(qid, best, depth) for the queries of ``support`` (qid, path): the rank of the best supporting document among all, and the sum of
    ``size`` up to it; null if it is no hit.

    Ranks are counted, not sorted: supporting documents are scored first, then the documents before the best of them.
    """
    spark, texts = docs.sparkSession, bags(docs, [size.cast("long").alias("size")])
    (asked, mean), out = weighed(texts, queries), None
    for block in asked.blocks():
        first, number, held = block.first, block.queries, spark.sparkContext.broadcast(block)
        mine = support.select("qid", "path").distinct().join(asked.numbers.where(F.col("n").between(first, first + number - 1)), "qid")

        def own(batches: Iterator[pa.RecordBatch], first=first, held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column(3).to_numpy() - first
                value = np.concatenate([v[np.arange(high - low), n[low:high]] for low, high, v in held.value.bm25(batch.column(1), mean)])
                yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(2), pa.array(value)], names=["n", "path", "size", "score"])

        scored = texts.join(mine.select("n", "path"), "path").select("path", "bag", "size", "n").mapInArrow(own, "n long, path string, size long, score double").where("score > 0")
        top = [tuple(r) for r in scored.groupBy("n").agg(F.min_by(F.struct("score", "path", "size"), F.struct(-F.col("score"), "path")).alias("b")).select("n", "b.*").collect()]  # a row a query of the block
        marks = spark.sparkContext.broadcast(top)

        def before(batches: Iterator[pa.RecordBatch], first=first, held=held, marks=marks) -> Iterator[pa.RecordBatch]:
            known = sorted(marks.value)
            at = np.array([n - first for n, *_ in known], np.int64)
            mark, name = np.array([s for _, s, *_ in known]), np.array([p for _, _, p, _ in known], dtype=object)
            count, depth = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for batch in batches:
                paths, sizes = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(2).to_numpy()
                for low, high, value in held.value.bm25(batch.column(1), mean) if len(at) else ():
                    value = value[:, at]
                    ahead = value > mark
                    for d, q in zip(*np.nonzero(value == mark)):
                        ahead[d, q] = paths[low + d] < name[q]
                    count += ahead.sum(axis=0)
                    depth += sizes[low:high] @ ahead
            yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(count), pa.array(depth)], names=["n", "count", "depth"])

        found = texts.select("path", "bag", "size").mapInArrow(before, "n long, count long, depth long").groupBy("n").agg(F.sum("count").alias("count"), F.sum("depth").alias("depth"))
        own_size = spark.createDataFrame([(n, size) for n, _, _, size in top], "n long, size long")
        part = written(found.join(own_size, "n").select("n", (F.col("count") + 1).alias("best"), (F.col("depth") + F.col("size")).alias("depth")))
        held.unpersist()
        marks.unpersist()
        out = part if out is None else out.union(part)
    wanted = support.select("qid").distinct()
    if out is None:
        return wanted.select("qid", F.lit(None).cast("long").alias("best"), F.lit(None).cast("long").alias("depth"))
    return wanted.join(out.join(asked.numbers, "n").select("qid", "best", "depth"), "qid", "left")


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, path, score, rank): the ``k`` rows of (path, embedding) nearest to each query (qid, embedding) by cosine.

    Queries are handled in blocks of ``BLOCK``, which is all that the driver and a task hold of them. A task
    multiplies its rows with a block and hands on its best ``k``. Rows without a vector are no hits.
    """
    spark = vectors.sparkSession
    numbered = written(row_numbers(queries.select("qid", "embedding"), ["qid"]))
    last = numbered.agg(F.max("n")).first()[0] or 0
    out = spark.createDataFrame([], "n long, path string, score double") if not last else None
    for first in range(1, last + 1, BLOCK):
        some = [r["embedding"] for r in numbered.where(F.col("n").between(first, first + BLOCK - 1)).orderBy("n").collect()]
        matrix = np.array(some, float).reshape(len(some), -1)
        held = spark.sparkContext.broadcast(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12))

        def task(batches: Iterator[pa.RecordBatch], held=held, first=first) -> Iterator[pa.RecordBatch]:
            matrix = held.value
            best = Best(len(matrix), k)
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                if not len(batch):
                    continue
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                paths = np.array(batch.column(0).to_pylist(), dtype=object)
                for low in range(0, len(rows), ROWS):
                    best.take(np.round(rows[low : low + ROWS] @ matrix.T, 6) + 0.0, paths[low : low + ROWS])
            yield best.batch(first)

        part = vectors.select(F.col("path").cast("string"), "embedding").mapInArrow(task, "n long, path string, score double")
        if last > BLOCK:
            part = written(ranked(part, "n", k).drop("rank"))
            held.unpersist()
        out = part if out is None else out.union(part)
    return ranked(out.join(numbered.select("n", "qid"), "n").select("qid", "path", "score"), k=k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, without Python."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fuse(lists: DataFrame, k: int | None = None, rrf_k: int = RRF_K, pin: bool = False) -> DataFrame:
    """Reciprocal rank fusion of (qid, variant, path, rank): (qid, path, score, rank).

    Ties go to the path seen first: in the lowest variant, at the best rank there. With ``pin`` the
    first variant's best stays on top.
    """
    seen = F.min(F.struct("variant", "rank"))
    fused = lists.groupBy("qid", "path").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), seen.alias("seen"))
    pinned = F.when(F.lit(pin) & (F.col("seen.variant") == 0) & (F.col("seen.rank") == 1), 0).otherwise(1)
    order = Window.partitionBy("qid").orderBy(pinned, F.desc("score"), "seen", "path")
    out = fused.withColumn("rank", F.row_number().over(order).cast("long")).select("qid", "path", "score", "rank")
    return out if k is None else out.where(F.col("rank") <= k)


def best_rank(lists: DataFrame) -> DataFrame:
    """The alternative to fusion: each path at its best rank in any variant."""
    best = lists.groupBy("qid", "path").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("best", "path")).cast("long"))


def review_policy(hits: DataFrame, policy: str, penalty: float = 0.5) -> DataFrame:
    """Drops (exclude), marks down (demote) or keeps (ignore) hits under review, and ranks anew."""
    if policy == "exclude":
        hits = hits.where(~F.col("needs_review"))
    elif policy == "demote":
        hits = hits.withColumn("score", F.when(F.col("needs_review"), F.round(F.col("score") * penalty, 6)).otherwise(F.col("score")))
    return ranked(hits.drop("rank"))


def over_fetch(k: int, policy: str, rerank: int = 20) -> int:
    """How many hits to fetch so that a policy leaves enough."""
    return k if policy == "ignore" else max(2 * k, rerank, k + 10)


def within_budget(hits: DataFrame, tokens: Column, budget: int, header: int = 0) -> DataFrame:
    """The hits before the first that overflows the budget, with ``used`` tokens so far."""
    used = F.lit(header) + F.sum(tokens).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("used", used.cast("long")).where(F.col("used") <= budget)


def relevance(hits: DataFrame, queries: DataFrame, support: DataFrame) -> DataFrame:
    """The best rank of a supporting document among given hits for each query, null if there is none."""
    found = hits.join(support, ["qid", "path"], "left_semi").groupBy("qid").agg(F.min("rank").alias("best"))
    return queries.select("qid").join(found, "qid", "left")


def quality(best: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at k, mean reciprocal rank and NDCG at 10 (one relevant document) over all queries."""
    within = lambda k: F.coalesce(F.col("best") <= k, F.lit(False))
    share = lambda c: F.round(F.avg(c), 6)
    return best.agg(
        F.count(F.lit(1)).alias("queries"), *[share(within(k).cast("double")).alias(f"recall_{k}") for k in at],
        share(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"), share(F.when(within(10), 1.0 / F.log2(F.col("best") + 1.0)).otherwise(0.0)).alias("ndcg_10"),
    )
