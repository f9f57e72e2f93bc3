"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are token sequences: lower-cased words, then one end. Counts of all tokens of the training rows
come first (partial counts in the tasks, then one shuffle), whatever their number. The ``HEAD`` most frequent
tokens get a Huffman code; one more code word stands for all others, and what follows it is
the other token's smoothed share among the others.

Each bit of a code word is predicted several times: by the Huffman tree's own share, and by the bits
seen in training after the hash of the last token, of the last two, and of the last frequent token before
the last. Counts of each context, in a table that the hash indexes, are drawn towards the tree's share.
The predictions' logits are summed with weights that a gate, the depth in the tree, selects. After each
bit the weights move along the gradient of its coding cost. They begin at ``WEIGHTS``, which no row decides, and anew every
``RUN_BITS`` bits, so that a text's runs can be computed side by side; contexts reach over such borders.

The mix is then refined by what the whole corpus holds. A text is cut into segments where the hash of its last three
symbols says so, on average every ``STEP`` symbols, so that equal passages are cut alike. How often each segment, and each context of a
segment, occurs in training rows is counted exactly, whatever their number: a task asks for the distinct keys of a part of the
texts, and keys are dealt by hash. A segment that was seen after its context has a second prediction, the share
of the context's occurrences that it followed. The two are averaged with a trust that follows how
often this one was right lately in the same text. A training row's own occurrence is left out of these counts, so that a text which occurs
once is scored as a new one, and copies are told apart.

The score is a proper log probability over sequences of known tokens and "any unknown token", the same
events as those of the smoothed unigram base (of a training row, given all other segments of the corpus). Rare tokens' counts come
by a join: only tokens beyond the head leave their task, once for each document and token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens with a code word of their own, and their bytes at most; longer tokens have none.
HEAD, HEAD_BYTES, LONGEST = 131_072, 8 << 20, 256
#: Bits of a context table's index; bits of a run.
TABLE_BITS, RUN_BITS = 18, 2048
#: Draw towards the tree's share; weights of tree, order 1, order 2, skip at the start of a run; rate of steps; gates.
DRAW, WEIGHTS, RATE, GATES = 4.0, (0.1, 0.35, 0.15, 0.4), 0.03, 16
#: Tokens that serve as the skip context: those of lowest rank.
FREQUENT = 256
CONTEXTS, BLOCK = 3, 1 << 13
#: Bits that are made ready for mixing at once, or those of one turn.
MIXED_BITS = 1 << 16
#: Symbols of a segment on average; bytes of text whose distinct keys are asked for at once; keys that a task counts at once.
STEP, CHUNK_BYTES, SHARD_KEYS = 12, 16 << 20, 1_000_000
#: Pseudo-counts of right and wrong predictions by segments, and how many of the latest ones count.
RIGHT, WRONG, WINDOW = 0.25, 0.75, 32
#: Bytes of text whose words are counted at once, and those that are mixed at once.
COUNT_BYTES, _SLICE = 32 << 20, 2 << 20
#: Factors of the hash of a context and a node.
_PLACE, _SLOT = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)


class Code(NamedTuple):
    """A Huffman code over the head's tokens and, as the last symbol, all others."""

    tokens: pa.Array  # binaries, by rank; the end is empty
    counts: np.ndarray
    first: np.ndarray  # where a symbol's bits begin
    bits: np.ndarray  # node << 5 | gate << 1 | bit; the gate is the depth of the bit, at most GATES - 1
    share: np.ndarray  # of bit 1, by node
    drawn: np.ndarray  # the share's logit and the share times DRAW, by node
    end: int

    @property
    def node(self) -> np.ndarray:
        return self.bits >> 5

    @property
    def gate(self) -> np.ndarray:
        return self.bits >> 1 & GATES - 1

    @property
    def bit(self) -> np.ndarray:
        return self.bits & 1


def huffman(tokens: list[bytes], counts: list[int], other: int) -> Code:
    """Ties go to the lower symbol, so that one set of counts has one code."""
    weights = [max(1, c) for c in [*counts, other]]
    n = len(weights)
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    weight, parent, side = weights + [0] * (n - 1), [-1] * (2 * n - 1), [0] * (2 * n - 1)
    for inner in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = inner
        side[j], weight[inner] = 1, a + b
        heapq.heappush(heap, (a + b, inner))
    par, sides, wt = np.array(parent), np.array(side), np.array(weight, float)
    ones = np.zeros(max(1, n - 1))
    right = np.flatnonzero((sides == 1) & (par >= 0))
    ones[par[right] - n] = wt[right]
    share = (ones + 0.5) / (np.append(wt[n:], [0])[: len(ones)] + 1)
    # From the root, the last node, down: depths.
    depth = np.zeros(2 * n - 1, np.int64)
    level = np.flatnonzero(par == 2 * n - 2) if n > 1 else np.zeros(0, np.int64)
    children = np.argsort(par, kind="stable")
    edges = np.searchsorted(par[children], np.arange(2 * n))
    while len(level):
        depth[level] = depth[par[level]] + 1
        inner = level[level >= n]
        level = np.concatenate([children[edges[inner]], children[edges[inner] + 1]])
    first = np.zeros(n + 1, np.int64)
    np.cumsum(depth[:n], out=first[1:])
    node, bit = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int8)
    at, up = first[1:] - 1, np.arange(n)
    todo = np.flatnonzero(par[up] >= 0)
    while len(todo):
        now = up[todo]
        node[at[todo]], bit[at[todo]] = par[now] - n, sides[now]
        at[todo] -= 1
        up[todo] = par[now]
        todo = todo[par[up[todo]] >= 0]
    gate = np.minimum(np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first)), GATES - 1).astype(np.int32)
    drawn = np.stack([np.log(share / (1 - share)), DRAW * share], axis=1).astype(np.float32)
    return Code(pa.array(tokens, pa.large_binary()), np.array(counts, np.int64), first, node << 5 | gate << 1 | bit, share, drawn, tokens.index(b""))


class Slice:
    """The tokens of a slice of texts as symbols, with their bits and contexts."""

    def __init__(self, code: Code, raw: np.ndarray, at: np.ndarray):
        low = common.LOWER.take(raw)
        starts, ends, first = common.word_spans(raw, at)
        coded = common.words_array(low, starts, ends).dictionary_encode()
        self.words = coded.dictionary
        rank = pc.fill_null(pc.index_in(self.words, value_set=code.tokens), len(code.counts)).to_numpy().astype(np.int64)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        n, texts = len(starts), len(at) - 1
        place = np.arange(n) + np.repeat(np.arange(texts), np.diff(first))  # ends stand between the words
        self.symbols = np.full(n + texts, code.end, np.int64)
        self.symbols[place] = rank[which] if n else 0
        self.word = np.full(n + texts, -1, np.int64)
        self.word[place] = which
        self.first = first + np.arange(texts + 1)
        self.text = np.repeat(np.arange(texts), np.diff(self.first))
        # Rare tokens are told apart as contexts by their last two bytes.
        tail = np.full(n + texts, -1, np.int64)
        if n:
            tail[place] = low[ends - 1].astype(np.int64) << 8 | np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0)
        seen = np.where(self.symbols == len(code.counts), len(code.counts) + 1 + tail, self.symbols) + 1
        begins = np.zeros(n + texts, dtype=bool)
        begins[self.first[:-1][self.first[:-1] < n + texts]] = True
        last = np.concatenate([[0], seen[:-1]]) if len(seen) else seen
        last[begins] = 0
        before = np.concatenate([[0], last[:-1]]) if len(last) else last
        before[begins] = 0
        # The last frequent token before the last token: by the place of the latest one so far, within its text.
        index = np.arange(n + texts)
        latest = np.maximum.accumulate(np.where((self.symbols < FREQUENT) & (self.symbols != code.end), index, -1)) if n + texts else index
        skip_at = np.concatenate([[-1, -1], latest[:-2]])[: n + texts]
        inside = skip_at >= np.repeat(self.first[:-1], np.diff(self.first))
        skip = np.where(inside, seen[np.maximum(skip_at, 0)], 0)
        count = code.first[self.symbols + 1] - code.first[self.symbols]
        upto = np.cumsum(count)
        self.bits = np.diff(np.append(0, upto)[self.first])
        begin = code.first.take(self.symbols)
        self.token, self.count = np.repeat(index.astype(np.int32), count), count
        at_bit = np.repeat((begin - upto + count).astype(np.int32), count)
        at_bit += np.arange(len(at_bit), dtype=np.int32)
        self.code = code.bits.take(at_bit)
        salt = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
        contexts = (last.astype(np.uint64) * salt[0], (last.astype(np.uint64) * salt[1]) ^ common.mixed(before), skip.astype(np.uint64) * salt[2])
        self.contexts = [(common.mixed(c + np.uint64(k + 1)) >> np.uint64(32)).astype(np.uint32) for k, c in enumerate(contexts)]

    @property
    def bit(self) -> np.ndarray:
        return self.code & 1

    def slots(self, k: int) -> np.ndarray:
        h = np.repeat(self.contexts[k], self.count)
        h ^= (self.code >> 5).view(np.uint32) * _PLACE
        h *= _SLOT
        h >>= np.uint32(32 - TABLE_BITS)
        return h.astype(np.int64)

    def marks(self) -> Iterator[np.ndarray]:
        """For each context, its slots times two plus the bit."""
        places = (self.code >> 5).view(np.uint32) * _PLACE
        bit = self.bit.view(np.uint32)
        for c in self.contexts:
            h = np.repeat(c, self.count)
            h ^= places
            h *= _SLOT
            h >>= np.uint32(31 - TABLE_BITS)
            h &= np.uint32(0xFFFFFFFE)
            h |= bit
            yield h.view(np.int32)

    def segments(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (of the context and of context and segment) of each segment, the sum of its bits' values, and where each text's segments begin, the end last."""
        n = len(self.symbols)
        h = common.mixed(self.symbols.astype(np.uint64) + np.uint64(1))
        place = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        context = np.zeros(n, np.uint64)  # of the three symbols before
        for back, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
            known = place >= back
            context[known] += h[np.flatnonzero(known) - back] * np.uint64(salt)
        context = common.mixed(context)
        begins = np.flatnonzero((place == 0) | (context % np.uint64(STEP) == 0))
        ends = np.append(begins[1:], n)
        up, down = common.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        whole = common.mixed((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        keys = np.stack([common.mixed(context[begins] ^ np.uint64(0x2545F4914F6CDD1D)), common.mixed(whole ^ context[begins])], axis=1)
        by_token = np.add.reduceat(bits, np.cumsum(self.count) - self.count, dtype=np.float64) if n else np.zeros(0)  # a token has a bit at least
        return keys, np.add.reduceat(by_token, begins) if n else by_token, np.searchsorted(begins, self.first)


def token_counts(train: DataFrame) -> DataFrame:
    """(token, n) over all rows (text) of ``train``; the end is the empty token."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def counted() -> list[pa.RecordBatch]:
            found = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.table({"token": found.field(0), "n": found.field(1)}).to_batches(max_chunksize=50_000)

        for batch in batches:
            for part, raw, at in common.slices(batch):
                starts, ends, _ = common.word_spans(raw, at)
                held.append(common.words_array(common.LOWER.take(raw), starts, ends).cast(pa.binary()))
                size, texts = size + len(raw), texts + len(part)
                if size >= COUNT_BYTES:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()
        if texts:
            yield pa.RecordBatch.from_pydict({"token": pa.array([b""], pa.binary()), "n": pa.array([texts], pa.int64())})

    return train.mapInArrow(common.lean(task), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def context_counts(train: DataFrame, code) -> DataFrame:
    """(block, data): training bits of each slot of the context tables, summed over all tasks.

    Tasks' tables are added up in groups of 32 until one is left of each block.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CONTEXTS, 2 << TABLE_BITS), np.int64)
        some = False
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=_SLICE):
                for k, marks in enumerate(Slice(code.value, raw, at).marks()):
                    total[k] += np.bincount(marks, minlength=2 << TABLE_BITS)
                some = True
        if some:
            flat = total.ravel()
            for block in range(len(flat) // BLOCK):
                data = flat[block * BLOCK : (block + 1) * BLOCK]
                if data.any():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "block": pa.array([block], pa.int32()), "data": pa.array([data.astype("<i8").tobytes()], pa.binary())})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for data in rows["data"]:
            total += np.frombuffer(data, "<i8")
        return pd.DataFrame({"part": [key[1]], "block": [key[0]], "data": [total.astype("<i8").tobytes()]})

    tables = train.mapInArrow(common.lean(task), "part long, block int, data binary")
    parts = train.rdd.getNumPartitions()
    while True:
        parts = -(-parts // 32)
        tables = tables.groupBy("block", F.floor(F.col("part") / 32).alias("__g")).applyInPandas(add, "part long, block int, data binary")
        if parts <= 1:
            return tables.select("block", "data")


def mix(s: Slice, code: Code, tables: np.ndarray, start: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """The natural log probability of each bit of a slice, and the weights (run, gate, input) after it."""
    # Runs of at most RUN_BITS bits of one text, the longest first, go on side by side.
    bits = s.bits
    runs = -(-bits // RUN_BITS)
    order_in = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = np.repeat(np.cumsum(bits) - bits, runs) + order_in * RUN_BITS
    length = np.minimum(RUN_BITS, np.repeat(bits, runs) - order_in * RUN_BITS)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left").tolist()
    # Weights are kept with their signs changed, so that sums are the negated logits that a logistic function takes.
    weights = np.tile(-start.astype(np.float32), (len(begin), 1))
    weight_rows = weights.view(np.complex128).ravel()  # four values are taken and put at once
    lane = np.arange(len(begin)) * GATES
    contexts = np.zeros((len(s.symbols), 4), np.uint32)
    for k in range(CONTEXTS):
        contexts[:, k] = s.contexts[k]
    context_rows, drawn_rows = contexts.view(np.complex128).ravel(), code.drawn.view(np.float64).ravel()
    table_rows = [t.view(np.float64).ravel() for t in tables]
    logs = np.empty(len(s.code), np.float32)
    # Some turns' bits at a time, in the order in which they are mixed: of all runs the first, then of all the second, and so on.
    first = 0
    while first < len(live):
        last, size = first, 0
        while last < len(live) and (last == first or size + live[last] <= MIXED_BITS):
            size, last = size + live[last], last + 1
        at = np.concatenate([begin[:n] + turn for turn, n in enumerate(live[first:last], first)])
        coded = s.code.take(at)
        node = coded >> 5
        target = (coded & 1).astype(np.float32)
        gates = coded >> 1 & GATES - 1
        x = np.empty((size, 1 + CONTEXTS), np.float32)
        known = drawn_rows.take(node).view(np.float32).reshape(-1, 2)  # both values at once
        x[:, 0] = known[:, 0]
        one = known[:, 1].copy()
        nil = DRAW - one
        places = node.view(np.uint32) * _PLACE
        hashes = context_rows.take(s.token.take(at)).view(np.uint32).reshape(-1, 4)
        for k in range(CONTEXTS):
            slots = hashes[:, k] ^ places
            slots *= _SLOT
            slots >>= np.uint32(32 - TABLE_BITS)
            both = table_rows[k].take(slots.view(np.int32), mode="clip").view(np.float32).reshape(-1, 2)
            ratio = both[:, 1] + one
            ratio /= both[:, 0] + nil
            x[:, k + 1] = np.log(ratio, out=ratio)
        steps, minus, a = rate * target, np.empty(size, np.float32), 0
        for n in live[first:last]:
            place, b = gates[a : a + n] + lane[:n], a + n
            w, xs, z = weight_rows.take(place).view(np.float32).reshape(n, -1), x[a:b], minus[a:b]
            part = xs * w
            np.add(part[:, 0], part[:, 1], out=z)
            z += part[:, 2]
            z += part[:, 3]
            p = np.exp(z)
            p += 1
            np.divide(rate, p, out=p)
            p -= steps[a:b]
            xs *= p.repeat(4).reshape(n, -1)
            xs += w
            weight_rows[place] = xs.view(np.complex128).ravel()
            a = b
        target *= 2
        target -= 1
        minus.clip(-25, 25, out=minus)
        minus *= target
        np.exp(minus, out=minus)
        minus += 1
        logs[at] = -np.log(minus, out=minus)
        first = last
    return logs, -weights.reshape(-1, GATES, 1 + CONTEXTS)


def segment_counts(scored: DataFrame) -> DataFrame:
    """(chunk, keys, counts): for the keys of each chunk how often training rows hold them, where more than one does or where no row of the chunk does."""
    n_keys = scored.agg(F.coalesce(F.sum(F.length("keys") / 8), F.lit(0))).first()[0]
    n_shards = max(1, int(-(-n_keys // SHARD_KEYS)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def asked() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held])
            own = np.concatenate([np.full(len(k), not out, np.int64) for k, out in held])
            keys, which = np.unique(keys, return_inverse=True)
            outside = np.bincount(which, own == 0) > 0  # asked for by a row that was not learned from
            own = np.bincount(which, own).astype("<u4") | outside.astype("<u4") << np.uint32(31)
            shard = (keys >> np.uint64(20)) % np.uint64(n_shards)
            order = np.argsort(shard, kind="stable")
            keys, own, shard = keys[order], own[order], shard[order]
            edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else shard
            for a, b in zip(edge, np.append(edge[1:], len(keys))):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[a])], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "keys": pa.array([keys[a:b].tobytes()], pa.binary()), "own": pa.array([own[a:b].tobytes()], pa.binary())})

        for batch in batches:
            for now, out, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now != chunk:
                    if held:
                        yield from asked()
                    chunk, held = now, []
                held.append((np.frombuffer(raw.as_buffer(), "<u8"), out))
        if held:
            yield from asked()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def answers() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for _, k, _ in held])
            own = np.concatenate([o for _, _, o in held])
            outside, own = own >> np.uint32(31), own & np.uint32(0x7FFFFFFF)
            _, which = np.unique(keys, return_inverse=True)
            total = np.bincount(which, own)[which].astype("<u4")
            tell = total > (outside == 0)
            edge = np.cumsum([0, *(len(k) for _, k, _ in held)])
            for (chunk, k, _), a, b in zip(held, edge, edge[1:]):
                some = tell[a:b]
                if some.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "keys": pa.array([k[some].tobytes()], pa.binary()), "counts": pa.array([total[a:b][some].tobytes()], pa.binary())})

        for batch in batches:
            for now, chunk, keys, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if now != shard:
                    if held:
                        yield from answers()
                    shard, held = now, []
                held.append((chunk, np.frombuffer(keys.as_buffer(), "<u8").copy(), np.frombuffer(own.as_buffer(), "<u4").copy()))
        if held:
            yield from answers()

    asked = scored.select("chunk", "held_out", "keys").mapInArrow(common.lean(ask), "shard long, chunk long, keys binary, own binary")
    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(common.lean(answer), "chunk long, keys binary, counts binary")


def trusted(keys: np.ndarray, logs: np.ndarray, known: np.ndarray, counts: np.ndarray, held_out: bool) -> float:
    """The natural log probability of a text: its segments' keys and mixed log probabilities, and the counts told of its chunk's keys (ascending)."""
    n = np.zeros(keys.shape, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        there = known[at] == keys
        n[there] = counts[at[there]].astype(np.int64) - (not held_out)
    seen = np.flatnonzero(n[:, 0] > 0)
    if not len(seen):
        return float(logs.sum())
    q = np.minimum(n[seen, 1] / n[seen, 0], 1.0)
    own = logs[seen]
    with np.errstate(divide="ignore"):
        told = np.log(q)
    right = np.concatenate([[0.0], np.cumsum(np.exp(told - np.logaddexp(told, own)))])
    index = np.arange(len(seen))
    low = np.maximum(index - WINDOW, 0)
    trust = (RIGHT + right[index] - right[low]) / (RIGHT + WRONG + index - low)
    out = logs.copy()
    out[seen] = np.logaddexp(np.log(trust) + told, np.log1p(-trust) + own)
    return float(out.sum())


def head_of(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The tokens with codes and their counts: whole classes of frequency, a sixteenth of an octave each, from the top, while they fit."""
    octave, short = F.floor(F.log2("n") * 16), F.length("token") <= LONGEST
    classes = counts.where(short).groupBy(octave.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("bytes")).collect()
    least, room, space = None, HEAD, HEAD_BYTES
    for r in sorted(classes, key=lambda r: -r["c"]):
        room, space = room - r["n"], space - r["bytes"]
        if room < 0 or space < 0:
            break
        least = r["c"]
    found = counts.where((F.length("token") == 0) | short & (octave >= least if least is not None else F.lit(False))).collect() or [{"token": b"", "n": 0}]
    return sorted(((bytes(r["token"]), r["n"]) for r in found), key=lambda r: (-r[1], r[0]))


def refined(scored: DataFrame, told: DataFrame) -> DataFrame:
    """``scored`` with ``mixed``, the refined natural log probability, instead of its segments; ``told`` has counts of keys by chunk."""
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_head", "n_bytes", "base"]
    types = dict(scored.dtypes)
    empty = [F.lit(None).cast(types[c]).alias(c) for c in kept]
    rows = told.select("chunk", F.lit(False).alias("is_text"), "keys", F.col("counts").alias("data"), *empty).union(scored.select("chunk", F.lit(True), "keys", F.col("logs"), *kept))
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "is_text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts = None, []
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        for batch in batches:
            some, mixed = [], []
            columns = (batch.column(k).to_pylist() for k in (0, 1, 6))
            for k, (now, is_text, held_out) in enumerate(zip(*columns)):
                keys, data = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((2, "<u8"), (3, "<f4" if is_text else "<u4")))
                if now != chunk:
                    chunk, parts, known = now, [], None
                if not is_text:
                    parts.append((keys.copy(), data.copy()))
                    continue
                if known is None:  # the answers come first
                    known = np.concatenate([x for x, _ in parts] + [np.zeros(0, np.uint64)])
                    counts = np.concatenate([x for _, x in parts] + [np.zeros(0, np.uint32)])
                    order = np.argsort(known, kind="stable")
                    known, counts = known[order], counts[order]
                some.append(k)
                mixed.append(trusted(keys.reshape(-1, 2), data.astype(float), known, counts, held_out))
            if some:
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*(part.column(4 + k) for k in range(len(kept))), pa.array(mixed)], names=[*kept, "mixed"])

    return dealt.mapInArrow(common.lean(task), ", ".join(f"{c} {types[c]}" for c in kept) + ", mixed double")


def score_documents(docs: DataFrame, folds: int = 7, hold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row.

    Rows whose crc32(id as text) mod ``folds`` is ``hold`` are not learned from; a null id is learned from. Null
    texts are empty, and an empty text is one end token (bits_per_byte is null). Repeated rows are counted and scored
    as often as they come, each with the others as copies. Texts and words of any length are read whole; a word of more than ``LONGEST`` bytes is one of
    the others. Without training rows the only token with a code is the end. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == hold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), common.text_of(text_col).alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = common.written(token_counts(train.select("text")))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = head_of(counts)
    others, other_kinds = n_all - sum(n for _, n in head), max(0, v_all - len(head))
    code = spark.sparkContext.broadcast(huffman([w for w, _ in head], [n for _, n in head], others + 1))
    flat = np.zeros(CONTEXTS * (2 << TABLE_BITS), np.float32)
    for r in context_counts(train.select("text"), code).collect():  # of fixed size, whatever the corpus
        flat[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["data"], "<i8")
    tables = spark.sparkContext.broadcast(flat.reshape(CONTEXTS, -1, 2))
    start = np.tile(np.array(WEIGHTS, np.float32), (GATES, 1))
    base = np.log10(float(n_all + v_all + 1))
    rare = np.log10(float(others + other_kinds + 1))
    fields = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, n_bytes long, base double, chunk long, keys binary, logs binary, rare array<struct<token:binary,n:int>>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, row, taken = TaskContext.get().partitionId(), 0, 0
        known = code.value
        logs = np.append(np.log10(known.counts + 1.0), 0.0) - base
        for batch in batches:
            for part, raw, at in common.slices(batch, limit=_SLICE):
                s, n = Slice(known, raw, at), len(part)
                keys, values, edge = s.segments(mix(s, known, tables.value, start)[0])
                binaries = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edge * size).astype(np.int32)), pa.py_buffer(data)]) for size, data in ((16, np.ascontiguousarray(keys.astype("<u8"))), (4, values.astype("<f4")))]
                other = s.symbols == len(known.counts)
                head_score = np.bincount(s.text[~other], logs[s.symbols[~other]], minlength=n)
                pairs, times = np.unique(s.text[other] * np.int64(max(1, len(s.words))) + s.word[other], return_counts=True)
                text, word = np.divmod(pairs, max(1, len(s.words)))
                bounds = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([s.words.take(pa.array(word)).cast(pa.binary()), pa.array(times.astype(np.int32))], names=["token", "n"])
                tokens = np.diff(s.first)
                chunk = np.full(n, part_id << 24 | taken // CHUNK_BYTES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part_id << 33) + row + np.arange(n)), part.column(0), part.column(1), pa.array(tokens), pa.array(tokens - np.bincount(s.text[other], minlength=n)), pa.array(np.diff(at)), pa.array(head_score), pa.array(chunk), *binaries, pa.ListArray.from_arrays(pa.array(bounds), items)],
                    names=[x.split()[0] for x in fields.split(", ")],
                )
                row, taken = row + n, taken + len(raw)

    scored = common.written(rows.mapInArrow(common.lean(task), fields))
    mixed = refined(scored, segment_counts(scored))
    wanted = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.token").alias("token"), F.col("r.n").alias("times"))
    found = wanted.join(counts, "token", "left")
    log_count = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1.0)
    sums = found.groupBy("row").agg(F.sum(F.col("times") * log_count).alias("logs"), F.sum("times").alias("times"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    out = mixed.join(sums, "row", "left")
    times, logs, known = (F.coalesce(c, F.lit(0)) for c in ("times", "logs", "known"))
    score = F.col("mixed") / float(np.log(10)) + logs - times * rare
    n_known = F.col("n_head") + known if n_all else F.lit(0)
    return out.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + logs - times * base).alias("base_score"), score.alias("score"), F.when(F.col("n_bytes") > 0, -score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
