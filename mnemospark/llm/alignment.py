"""Alignment of two tokenizers over the same texts.

Tokens of both that overlap in a text are linked to a bipartite graph; its components, found by union-find, are the smallest groups
that both tokenizers bound alike. The members of a component expand into links: its A token and its B token that end together. Links are
counted as pairs of ids over the whole corpus, and each document is scored by the counts of its own.

Both tokenizers end a token before a blank that follows a letter or mark, so a text is cut there into chunks, whose alignments
are independent: a worker aligns each distinct chunk once and remembers it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

#: Chunks, and bytes of them, that a worker remembers.
MEMO_CHUNKS, MEMO_BYTES = 300_000, 96 << 20
#: Pairs that at least one link in so many has are looked up in a broadcast, which has no more rows than this; all others are joined.
HEAD = 1 << 18

_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x20] = True
_aligners: dict[tuple[str, str], "Aligner"] = {}


def byte_level() -> dict[str, int]:
    """The byte of each character in entries of byte-level vocabularies: visible Latin-1 stands for itself, the rest for 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first A, end A, first B, end B) of each component of the graph in which tokens that overlap are linked. ``a`` and ``b`` are
    the ends of all tokens, of the same bytes; components come in their order.

    Union-find over all edges at once: roots are hooked to smaller roots and paths are shortened, until no edge has two roots.
    """
    first = np.searchsorted(b, np.append(0, a[:-1]), side="right")
    many = np.searchsorted(b, a, side="left") + 1 - first
    upto = np.cumsum(many)
    u = np.repeat(np.arange(len(a)), many)
    v = len(a) + np.repeat(first - upto + many, many) + np.arange(len(u))
    root = np.arange(len(a) + len(b))
    while True:
        one, two = root[u], root[v]
        apart = one != two
        if not apart.any():
            break
        one, two = one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(root, root[root]):
            root = root[root]
    # A component's root is its first A token.
    begin = np.flatnonzero(root[: len(a)] == np.arange(len(a)))
    begin_b = np.searchsorted(root[len(a) :], begin)
    return begin, np.append(begin[1:], len(a))[: len(begin)], begin_b, np.append(begin_b[1:], len(b))[: len(begin)]


def written_ids(ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids in decimal, each with the byte in ``ends`` behind it, and where each begins (the end last)."""
    width = len(str(int(ids.max(initial=0))))
    digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1)
    shown = np.column_stack([digits % 10 + 48, ends]).astype(np.uint8)
    kept = np.column_stack([digits > 0, np.ones(len(ids), bool)])
    kept[:, width - 1] = True
    return shown[kept].tobytes(), np.append(0, np.cumsum(kept.sum(axis=1)))


class Vocabulary:
    """The bytes of all ids, side by side."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([*map(len, entries)], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.data[np.repeat(self.first[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


class Aligner:
    """Both tokenizers of a worker, and the alignments of chunks."""

    def __init__(self, path_a: str, path_b: str):
        import os

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        at, entries = byte_level(), self.a.get_vocab(with_added_tokens=True)
        named = {k: entry for entry, k in entries.items()}
        self.bytes_a = Vocabulary([bytes(at.get(c, 0) for c in named.get(k, "")) for k in range(max(named) + 1)])
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self.blank = self.b.piece_to_id("▁")
        # A piece that goes on after a blank may span a cut: then texts are aligned whole.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.held = 0
        self.shown: list[bytes] = []
        self.numbers, self.links = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)]

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode("utf-8") for c in chunks]
        coded_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts the blank before a text itself, but for an empty one.
        coded_b = [ids or [self.blank] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        many = [np.fromiter(map(len, x), np.int64, len(x)) for x in (coded_a, coded_b)]
        good = self._given_back(chunks, coded_a, coded_b, many)
        kept = np.flatnonzero(good).tolist()
        a, b = (np.fromiter(chain.from_iterable(x[k] for k in kept), np.int64) for x in (coded_a, coded_b))
        first_a, end_a, first_b, end_b = components(np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b]))
        # Tokens in the order in which they are shown: of each component A's, then B's.
        both, n = np.concatenate([a, b]), len(first_a)
        group = np.concatenate([np.repeat(np.arange(n) * 2, end_a - first_a), np.repeat(np.arange(n) * 2 + 1, end_b - first_b)])
        order = np.argsort(group, kind="stable")
        group = group[order]
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        shown, at = written_ids(both[order], np.where(last, np.where(group % 2, ord(";"), ord("|")), ord(",")))
        size = (many[0] + many[1]) * good
        at = at[np.append(0, np.cumsum(size))].tolist()
        per = np.zeros(len(chunks), np.int64)
        own = np.searchsorted(np.cumsum(many[0] * good), first_a, side="right")  # the chunk of a component
        np.add.at(per, own, 1)
        begin = len(self.shown)
        self.memo.update(zip(chunks, range(begin, begin + len(chunks))))
        self.shown += [shown[i:j] for i, j in zip(at, at[1:])]
        self.numbers.append(np.column_stack([*many, per, good]))
        self.links.append(a[end_a - 1] << 32 | b[end_b - 1])
        self.held += sum(map(len, chunks)) + len(shown) + 8 * n + 150 * len(chunks)

    def _given_back(self, chunks: list[bytes], coded_a: list, coded_b: list, many: list[np.ndarray]) -> np.ndarray:
        """Whether the tokens of both are the bytes of each chunk."""
        raw, size = b"".join(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks))
        good = np.ones(len(chunks), bool)
        for vocabulary, coded, count in ((self.bytes_a, coded_a, many[0]), (self.bytes_b, coded_b, many[1])):
            ids = np.fromiter(chain.from_iterable(coded), np.int64, int(count.sum()))
            data = vocabulary.bytes_of(ids).tobytes()
            total = np.append(0, np.cumsum(vocabulary.size[ids]))
            at = total[np.append(0, np.cumsum(count))]
            if data != raw or not np.array_equal(np.diff(at), size):
                at = at.tolist()
                good &= [data[i:j] == c for i, j, c in zip(at, at[1:], chunks)]
        return good

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of each chunk, its links, and where each chunk's begin."""
        self.numbers, self.links = [np.concatenate(self.numbers)], [np.concatenate(self.links)]
        count = self.numbers[0][:, 2]
        return self.numbers[0], self.links[0], np.cumsum(count) - count

    def align(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that each begin with a blank: (A tokens, B tokens, groups) and the digest of the groups of each, and the distinct links of
        each with how often they occur, with where each text's begin. Texts that are a blank alone, or that the tokens do not give back, have none."""
        begins = np.zeros(len(raw) + 1, dtype=bool)
        if self.cuts and len(raw) > 2:
            safe = tokens._PLAIN[raw]
            safe[1:] |= (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & tokens._TWO[raw[:-1]]
            begins[1:-1] = _BLANK[raw[1:]] & safe[:-1]
        begins[at] = True
        begins[-1] = False
        cut = np.flatnonzero(begins)
        if len(self.memo) > MEMO_CHUNKS or self.held > MEMO_BYTES:
            self._forget()
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(cut, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.memo]
        for k in range(0, len(new), 4096):
            self._learn(new[k : k + 4096])
        slots = np.array([self.memo[w] for w in words], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        numbers, links, begin = self.arrays()
        edge = np.searchsorted(cut, at)  # of texts among chunks; none is empty
        sums = np.zeros((len(slots) + 1, 4), np.int64)
        np.cumsum(numbers[slots], axis=0, out=sums[1:])
        per = sums[edge[1:]] - sums[edge[:-1]]
        good = (per[:, 3] == np.diff(edge)) & (np.diff(at) > 1)
        order = slots.tolist()
        digests = [hashlib.sha256(b"".join([self.shown[s] for s in order[i:j]])[:-1]).hexdigest() if ok else "" for i, j, ok in zip(edge, edge[1:], good.tolist())]
        text = np.repeat(np.arange(len(at) - 1), np.diff(edge))
        kept = good[text]
        used, text = slots[kept], text[kept]
        count = numbers[used, 2]
        upto = np.cumsum(count)
        flat = links[np.repeat(begin[used] - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)]
        distinct, place = np.unique(flat, return_inverse=True)
        both, times = np.unique(np.repeat(text, count) * max(1, len(distinct)) + place.ravel(), return_counts=True)
        owner, place = np.divmod(both, max(1, len(distinct)))
        return per[:, :3] * good[:, None], digests, distinct[place], times, np.searchsorted(owner, np.arange(len(at)))


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and Python worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, groups_sha256, pairs, times) of each row: its tokens, groups and links, a link as A's id times 2^32 and B's id.

    Written, since all that follows reads it: texts are encoded once.
    """
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(path_a, path_b)
        for batch in batches:
            for part, raw, at in common.slices(batch):
                per, digests, pairs, times, begin = one.align(raw, at)
                begin = pa.array(begin.astype(np.int32))
                lists = [pa.ListArray.from_arrays(begin, pa.array(x.astype(np.int64))) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(per[:, k])) for k in range(3)], pa.array(digests, pa.string()), *lists], names=schema.names[:])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
    texts = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), common.text_of(text_col)).alias("text"))
    return common.written(texts.mapInArrow(common.lean(task), schema).withColumn("row", F.monotonically_increasing_id()))


def id_of(pair: Column, which: str) -> Column:
    return F.shiftright(pair, 32) if which == "a" else pair.bitwiseAND(F.lit((1 << 32) - 1))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of the rows of ``aligned``: the links of each pair of ids in all documents, and whether no other pair of its B id has more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = common.written(each.groupBy("pair").agg(F.sum("times").alias("n")))
    most = counts.groupBy(id_of(F.col("pair"), "b").alias("b")).agg(F.max("n").alias("most"))
    return common.written(counts.withColumn("b", id_of(F.col("pair"), "b")).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(rows: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """The rows of ``aligned`` with n_links, n_best and count_sum in place of their links.

    Pairs that hold one link in ``head`` or more are no more than ``head``, whatever the corpus: tasks look them up in a broadcast. What else a
    document has is joined with the counts, and no such pair is hot.
    """
    spark = rows.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where(F.col("n") * head >= total).toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast([frequent.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = held.value
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            pairs, times = (column(c).flatten().to_numpy() for c in ("pairs", "times"))
            size = column("pairs").value_lengths().to_numpy()
            text = np.repeat(np.arange(len(batch)), size)
            place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = []
            for value in (np.ones(len(pairs), np.int64), np.where(hit, best[place], 0) if len(known) else pairs * 0, np.where(hit, n[place], 0) if len(known) else pairs * 0):
                upto = np.append(0, np.cumsum(value * times))
                edge = np.append(0, np.cumsum(size))
                sums.append(pa.array((upto[edge[1:]] - upto[edge[:-1]]).astype(np.int64)))
            rest = pa.array(np.searchsorted(text[~hit], np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([column(c) for c in plain] + sums + lists, names=[*plain, *new, "pairs", "times"])

    plain, new = ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256"], ["n_links", "n_best", "count_sum"]
    long = T.LongType()
    schema = T.StructType([rows.schema[c] for c in plain] + [T.StructField(c, long) for c in new] + [T.StructField(c, T.ArrayType(long)) for c in ("pairs", "times")])
    near = common.written(rows.select(*plain, "pairs", "times").mapInArrow(common.lean(task), schema))
    held.unpersist()
    far = near.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = far.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best2"), F.sum(F.col("times") * F.col("n")).alias("sum2"))
    added = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return near.drop("pairs", "times").join(more, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", added("n_best", F.col("best2")), added("count_sum", F.col("sum2")), "groups_sha256")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """For each row of ``docs`` the tokens of both tokenizers, groups and links, and the corpus-wide counts of its links.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and no digest. Texts are
    encoded whole, however long; strings of special tokens are plain text; repeated rows are documents of their own and add
    to the counts; ties for the highest count are all best; a null id is kept; an empty table gives no rows; other columns are not read.
    """
    rows = aligned(docs, path_a, path_b, id_col, text_col)
    return scored(rows, pair_counts(rows), head).withColumnRenamed("id", id_col)
