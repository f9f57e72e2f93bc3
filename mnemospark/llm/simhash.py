"""SimHash near-duplicate groups, linked through BK-trees.

1. A task turns each text into a 64-bit fingerprint: a bit is set if it is set in over half of
   the XXH64 values of the text's word shingles.
2. Equal fingerprints are one node. Two that differ in at most r bits agree on at least
   blocks - r of ``blocks`` blocks of bits, so each node goes to a shard for each choice of
   ``agree`` blocks and its bits there, and linked nodes share a shard. Lonely shards go.
3. In each shard a BK-tree (children keyed by their Hamming distance to the parent) is
   built and searched for all its nodes, following only edges within the radius. A shard of more nodes than one tree holds
   is cut into finer shards by the same rule over its other bits, as often as that can part its nodes; only what is
   dense even then is split into several trees, which its nodes visit each. A shard's links are reduced to a
   spanning forest while it is searched, so that all pairs are never held.
4. Components of the links come from rounds of star contractions over written tables.

Trees are not broadcast to all executors: together they grow with the corpus. Each tree goes with its
shard to the tasks that search it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import common

#: Nodes of a tree; times that a shard of more is cut into finer ones.
SHARD_NODES, CUTS = 2048, 2
_LANES = np.uint64(0x0101010101010101)


def _bit_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the hashes of each text (from ``first``, the end last) have each of the 64 bits."""
    out = np.zeros((len(first) - 1, 64), np.int64)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    runs = -(-counts[full] // 255)  # a byte counts up to 255
    base = np.repeat(first[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    texts = np.cumsum(runs) - runs
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, base)
        out[full, bit::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), texts, axis=0)
    return out


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    """Signed 64-bit fingerprints of UTF-8 texts."""
    digest, hashes, first = xxhash.xxh64_intdigest, [], [0]
    for text in texts:
        words = text.lower().split()  # bytes: A-Z alone, and white space as [\x20\x09-\x0D]
        if words:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            n = max(1, len(words) - width + 1)
            starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
            hashes += [digest(line[a:b], 42) for a, b in zip(starts, ends[-n:].tolist())]
        first.append(len(hashes))
    first = np.array(first)
    set_bits = 2 * _bit_sums(np.array(hashes, np.uint64), first) > np.diff(first)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<i8").ravel().astype(np.int64)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp, and the row's key (__k1, __k2), for each row."""
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch):
                data, found = raw.tobytes(), []
                for k in range(0, len(part), 64):
                    found.append(fingerprints([data[at[i] : at[i + 1]] for i in range(k, min(k + 64, len(part)))], width))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(found)), part.column(2), part.column(3)], names=["doc_id", "fp", "__k1", "__k2"])

    text = common.text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *common.row_key(id_col, text)).mapInArrow(common.lean(task), "doc_id long, fp long, __k1 long, __k2 long")


class BKTree:
    """A BK-tree over distinct 64-bit values as arrays, built and searched a level at a time.

    The children of a node are the values nearest to it in insertion order, one for each
    distance; further values of that distance lie below that child.
    """

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        n = len(values)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        self.level = [np.zeros(min(n, 1), np.int64)]
        below, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(below):
            d = np.bitwise_count(self.values[below] ^ self.values[at]).astype(np.int64)
            _, which, group = np.unique(at * 65 + d, return_index=True, return_inverse=True)  # the first of each is the child
            children = below[which]
            self.parent[children], self.edge[children] = at[which], d[which]
            self.level.append(children)
            rest = np.ones(len(below), dtype=bool)
            rest[which] = False
            below, at = below[rest], children[group[rest]]
        order = np.lexsort((self.edge, self.parent))
        self.order = order
        self.keys = (self.parent * 65 + self.edge)[order]

    def search(self, probes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (probe, node) indices within the radius, for 256 probes at once."""
        probes = probes.astype(np.uint64)
        for k in range(0, len(probes), 256) if len(self.values) else ():
            q = np.arange(k, min(k + 256, len(probes)))
            node = np.zeros(len(q), np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            while len(q):
                d = np.bitwise_count(probes[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                found.append((q[near], node[near]))
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
                many = high - low
                upto = np.cumsum(many)
                q = np.repeat(q, many)
                node = self.order[np.repeat(low - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]
            yield np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a-b and the smallest node of each one's component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def block_masks(bits: list[int], radius: int, agree: int) -> list[int]:
    """Masks over the given bits: values that differ in at most ``radius`` of them agree under one mask at least."""
    blocks = min(radius + agree, len(bits))
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[cuts[k] : cuts[k + 1]]) for k in range(blocks)]
    return [sum(some) for some in combinations(parts, agree)]


def shard_masks(radius: int, agree: int, cuts: int) -> list[list[int]]:
    """For the first sharding and each finer one the masks, those of each parent side by side."""
    levels = [block_masks(list(range(64)), radius, agree)]
    for _ in range(cuts):
        rest = [[b for b in range(64) if not m >> b & 1] for m in levels[-1]]
        if min(map(len, rest)) < radius + agree:
            break
        levels.append([m | finer for m, bits in zip(levels[-1], rest) for finer in block_masks(bits, radius, agree)])
    return levels


def shards(nodes: DataFrame, radius: int, agree: int = 2) -> DataFrame:
    """(kind, bits, fp, n): nodes by shards, with the shard's size; ``kind`` is the mask. Lonely shards go."""
    levels = shard_masks(radius, agree, CUTS)
    out, now = None, nodes.select("fp", F.lit(0).alias("place"))
    for depth, masks in enumerate(levels):
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        each = len(masks) // (1 if depth == 0 else len(levels[depth - 1]))
        place = F.explode(F.sequence(F.col("place") * each, F.col("place") * each + each - 1)).alias("place")
        mask = F.element_at(F.array(*map(F.lit, signed)), F.col("place") + 1)
        cut = now.select("fp", place).withColumn("kind", mask).withColumn("bits", F.col("fp").bitwiseAND(F.col("kind")))
        sizes = common.written(cut.groupBy("place", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        members = cut.join(sizes, ["place", "bits"])
        if depth + 1 < len(levels):
            # A finer sharding makes ``each`` visits of a node, trees make one for each tree.
            finer = F.col("n") > SHARD_NODES * (len(levels[depth + 1]) // len(masks))
            dense = common.written(members.where(finer).select("fp", "place")) if not sizes.where(finer).isEmpty() else None
            members = members.where(~finer)
        else:
            dense = None
        members = members.select("kind", "bits", "fp", "n")
        out = members if out is None else out.union(members)
        if dense is None:
            return out
        now = dense
    return out


def links(nodes: DataFrame, radius: int, agree: int = 2) -> DataFrame:
    """(fp, root): within each shard, each node linked to others and the smallest of its component there."""
    members = shards(nodes, radius, agree).withColumn("trees", F.ceil(F.col("n") / SHARD_NODES).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    visits = members.select("kind", "bits", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    dealt = visits.select("kind", "bits", "tree", "fp", (F.col("own") == F.col("tree")).alias("inside")).repartition("kind", "bits", "tree").sortWithinPartitions("kind", "bits", "tree", "fp")

    def shard_links(fp: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(fp) == 2:
            near = int(np.bitwise_count(fp[:1].view(np.uint64) ^ fp[1:].view(np.uint64))[0]) <= radius
            return (fp[1:], fp[:1]) if near else (fp[:0], fp[:0])
        tree = fp[inside]
        nodes = root = fp[:0]
        for q, node in BKTree(tree).search(fp, radius):
            other = fp[q] != tree[node]
            nodes, root = forest(np.concatenate([nodes, fp[q][other]]), np.concatenate([root, tree[node][other]]))
        return nodes[nodes != root], root[nodes != root]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            kind, bits, tree = (table.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero((np.diff(kind) != 0) | (np.diff(bits) != 0) | (np.diff(tree) != 0)) + 1
            bounds = [0, *new.tolist(), *([len(kind)] if last else [])]
            fp, inside, out = table.column(3).to_numpy(), table.column(4).to_numpy(), []
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 1:
                    out.append(shard_links(fp[a:b], inside[a:b]))
            rows = pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(2)], names=["fp", "root"]) if out else None
            return rows, table.slice(bounds[-1])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) > 20_000:
                rows, rest = solve(pa.concat_tables(held), False)
                held = [rest]
                if rows is not None:
                    yield rows
        if held:
            rows, _ = solve(pa.concat_tables(held), True)
            if rows is not None:
                yield rows

    return dealt.mapInArrow(common.lean(task), "fp long, root long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id and the row's key for each row.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows fall into
    one component. Texts of any length are fingerprinted whole. Equal fingerprints of different texts are linked as all others are. Null
    ids stay null; a component of null ids alone has a null id. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    prints = common.written(fingerprint_table(docs, id_col, text_col, width))
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(nodes, radius)
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    rooted = common.written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", F.col("root").alias("__component"), "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "__component", "__k1", "__k2")
