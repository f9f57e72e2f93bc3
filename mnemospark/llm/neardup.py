"""Near-duplicate groups by Jaccard similarity of word shingles, verified on the shingles themselves.

1. A task turns each text into the set of its shingles' hashes and into its SimHash fingerprint. Equal sets are one node.
   Fingerprints are linked by BK-trees (``simhash``), and each component of them is a bucket. A node also has
   ``BANDS`` x ``ROWS`` minimum hashes; ``ROWS`` of them are a bucket, and two nodes of similarity s share
   one with probability 1 - (1 - s^ROWS)^BANDS: at 0.8 all but two in a million pairs do, above it fewer are missed.
2. Each member of a bucket is verified against the bucket's smallest: its shingle set and the other's are
   joined and counted. Components of these links come next.
3. Where a bucket's members still lie in different components, its members go, with their shingle sets, to trees: parts of the
   bucket of a bounded number of shingles, each with an index from shingle to members. Every member of the bucket
   visits each tree; one pass over the index counts the shingles that it shares with each member there, exactly, and
   only links that join two components leave the task. So each pair in a bucket is either linked by a path or has been
   compared, while a large group of near copies makes no more rows than it has members. The fingerprints' buckets and a few bands go first, as
   they join most components.

SimHash fingerprints alone do not reach the threshold: at a Jaccard similarity of 0.8 they differ in ten bits on average, and
radii that reach so far are beyond blocks of bits. So their trees find the closest pairs, and minimum hashes the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import common, simhash
from .decontam import _roll

BANDS, ROWS = 25, 4
#: Shingles of a tree, a set more; pairs of a node that one task joins; bands that are searched first.
TREE_SHINGLES, LANE_PAIRS, FIRST_BANDS = 400_000, 64, 3
_FACTORS = common.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_JOIN = common.mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, ascending, and where each text's begin, the end last.

    Fewer words than ``width`` are one shingle, none are none.
    """
    n = len(at) - 1
    starts, ends, first = common.word_spans(raw, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = common.span_hashes(common.LOWER[raw], starts, ends)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    hashes, owners = [], []
    if len(word) >= width:
        whole = text[: len(text) - width + 1] == text[width - 1 :]
        hashes.append(_roll(word, width)[whole])
        owners.append(text[: len(text) - width + 1][whole])
    for size in range(1, width):
        some = np.flatnonzero(words == size)
        if len(some):
            hashes.append(_roll(word, size)[first[some]])
            owners.append(some)
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(n + 1))


def minimum_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of minimum hashes for each text; texts without shingles have the largest values."""
    out = np.full((len(first) - 1, len(_FACTORS)), ~np.uint64(0))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for k, a in enumerate(_FACTORS):
            out[full, k] = np.minimum.reduceat(h * a, first[full])
    return out


def print_table(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, node, buckets, size of the set, fingerprint, and the row's key, for each row."""
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch):
                h, first = shingle_hashes(raw, at, width)
                size = np.diff(first)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mixed(h ^ np.uint64(0x5851F42D4C957F2D)))])
                node = common.mixed(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))
                low = minimum_hashes(h, first)
                band = common.mixed((low.reshape(-1, BANDS, ROWS) * _JOIN).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * BANDS, pa.int32()), pa.array(band.ravel().view(np.int64)))
                data = raw.tobytes()
                fp = np.concatenate([simhash.fingerprints([data[at[i] : at[i + 1]] for i in range(k, min(k + 64, len(part)))], width) for k in range(0, len(part), 64)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node.view(np.int64)), lists, pa.array(size.astype(np.int64)), pa.array(fp), part.column(2), part.column(3)], names=["doc_id", "node", "bands", "size", "fp", "__k1", "__k2"])

    text = common.text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *common.row_key(id_col, text)).mapInArrow(common.lean(task), "doc_id long, node long, bands array<long>, size long, fp long, __k1 long, __k2 long")


def set_table(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """node and hashes, the shingle set, for ``nodes`` (node, __k1, __k2)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch):
                h, first = shingle_hashes(raw, at, width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["node", "hashes"])

    text = common.text_of(text_col)
    rows = docs.select(text.alias("text"), *common.row_key(id_col, text)).join(nodes, ["__k1", "__k2"]).select("node", "text")
    return rows.mapInArrow(common.lean(task), "node long, hashes binary").dropDuplicates(["node"])


def _attached(pairs: DataFrame, sets: DataFrame, key: str, name: str) -> DataFrame:
    """``pairs`` with the set of their column ``key``; a node of many pairs is dealt to several tasks."""
    lanes = common.written(pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / LANE_PAIRS).cast("int").alias("lanes")))
    dealt = pairs.join(lanes, key).withColumn("lane", F.pmod(F.xxhash64("a", "b"), F.col("lanes")).cast("int")).drop("lanes")
    copies = sets.withColumnsRenamed({"node": key, "hashes": name}).join(lanes, key).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
    return dealt.join(copies, [key, "lane"]).drop("lane")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``threshold`` or more."""
    pairs = common.written(pairs.distinct())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in range(2)], names=["a", "b"])

    both = _attached(_attached(pairs, sets, "a", "x"), sets, "b", "y").select("a", "b", "x", "y")
    return common.written(both.mapInArrow(common.lean(task), "a long, b long"))


class Tree:
    """Members of a bucket by their shingles, and the components that links have joined so far."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.nodes: list[int] = []
        self.roots: list[int] = []
        self.sets: list[np.ndarray] = []
        self.keys: np.ndarray | None = None
        self.joined: dict[int, int] = {}

    def add(self, node: int, root: int, hashes: np.ndarray) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(hashes)

    def root(self, x: int) -> int:
        while (up := self.joined.get(x, x)) != x:
            x = up
        return x

    def index(self) -> None:
        whole = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        self.size = np.array([len(x) for x in self.sets], np.int64)
        order = np.argsort(whole, kind="stable")
        self.keys = whole[order]
        self.owner = np.repeat(np.arange(len(self.sets)), self.size)[order]

    def links(self, node: int, root: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Links of a visitor with members of other components, one for each component."""
        if self.keys is None:
            self.index()
        if all(self.root(r) == self.root(root) for r in set(self.roots)):
            return []
        low, high = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, side="right")
        many = high - low
        upto = np.cumsum(many)
        at = np.repeat(low - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)
        both = np.bincount(self.owner[at], minlength=len(self.nodes))
        out = []
        for k in np.flatnonzero((both > 0) & (both >= self.threshold * (self.size + len(hashes) - both) - 1e-9)):
            a, b = self.root(self.roots[k]), self.root(root)
            if a != b:
                self.joined[a] = b
                out.append((max(node, self.nodes[k]), min(node, self.nodes[k])))
        return out


def across(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between ``members`` (band, trees, node, root) of one bucket and two components."""
    own = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int")
    visits = members.select("band", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    visits = visits.select("band", "tree", (F.col("own") == F.col("tree")).alias("inside"), "node", "root").join(sets, "node")
    dealt = visits.select("band", "tree", "inside", "node", "root", "hashes").repartition("band", "tree").sortWithinPartitions("band", "tree", F.desc("inside"), "node")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, out = None, Tree(threshold), []

        def visit(node: int, root: int, hashes: np.ndarray) -> None:
            out.extend(tree.links(node, root, hashes))

        def settle() -> None:  # the members inside visit as well, once all are there
            for member in list(zip(tree.nodes, tree.roots, tree.sets)) if tree.keys is None else []:
                visit(*member)

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for (band, number, inside, node, root), raw in zip(keys, batch.column(5)):
                hashes = np.frombuffer(raw.as_buffer(), np.uint64)
                if group != (band, number):
                    settle()
                    group, tree = (band, number), Tree(threshold)
                if inside:
                    tree.add(node, root, hashes.copy())
                else:
                    settle()
                    visit(node, root, hashes)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])
                out.clear()
        settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return dealt.mapInArrow(common.lean(task), "a long, b long")


def fingerprint_buckets(prints: DataFrame, radius: int) -> DataFrame:
    """(node, size, kind, band): the components of fingerprints (``fp``) within ``radius`` bits, linked through BK-trees, as buckets of kind -1."""
    own = common.written(prints.select("node", "size", "fp").distinct())
    found = simhash.links(common.written(own.select("fp").distinct()), radius)
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("fp"), "root")
    return own.join(roots, "fp", "left").select("node", "size", F.lit(-1).alias("kind"), F.xxhash64(F.lit("tree"), F.coalesce("root", "fp")).alias("band")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """doc_id, __component and the row's key for each row: rows are linked if their shingle sets have a Jaccard similarity of ``threshold``.

    Null, empty and blank texts have the empty set and are one group; a text of fewer words than ``width`` is one shingle.
    Repeated rows fall into one component. Other columns are ignored. Candidates are fingerprints within ``radius`` bits, and buckets of minimum hashes.
    """
    prints = common.written(print_table(docs, id_col, text_col, width))
    nodes = common.written(prints.groupBy("node").agg(F.min(F.struct("__k1", "__k2")).alias("row"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    posts = nodes.select("node", "size", F.posexplode("bands").alias("kind", "band")).union(common.written(fingerprint_buckets(prints, radius)))
    buckets = common.written(posts.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("band", "low"))
    shared = common.written(posts.join(buckets, "band"))
    some = nodes.join(shared.select("node").distinct(), "node", "left_semi")
    sets = common.written(set_table(docs, some.select("node", "row.__k1", "row.__k2"), id_col, text_col, width))
    found = verified(shared.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")), sets, threshold)
    for bands in (F.col("kind") < FIRST_BANDS, F.col("kind") >= FIRST_BANDS):
        roots = common.written(components(found).select(F.col("node").alias("__node"), "root"))
        rooted = common.written(shared.where(bands).join(roots, F.col("node") == F.col("__node"), "left").select("band", "node", "size", F.coalesce("root", "node").alias("root")))
        trees = F.ceil(F.sum("size") / TREE_SHINGLES).cast("int")
        open_ = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.greatest(F.lit(1), trees).alias("trees")).where("low <> high").select("band", "trees")
        found = found.union(common.written(across(rooted.join(open_, "band"), sets, threshold)))
    roots = components(found).select(F.col("node").alias("__node"), "root")
    return prints.join(roots, F.col("node") == F.col("__node"), "left").select("doc_id", F.coalesce("root", "node").alias("__component"), "__k1", "__k2")
