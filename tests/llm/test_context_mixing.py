"""The language model against plain loops, and copies against texts that occur once."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import common, lm

from .helpers import docs, words

MASK = (1 << 64) - 1


def mixed(h):
    h &= MASK
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Slow:
    """One text at a time, one bit at a time."""

    def __init__(self, code):
        self.code = code
        self.rank = {t.as_py(): k for k, t in enumerate(code.tokens)}

    def symbols(self, text):
        return [self.rank.get(w.encode(), len(self.rank)) for w in [*words(text), ""]]

    def seen(self, text):
        out = []
        for w, k in zip(words(text), self.symbols(text)):
            b = w.encode()
            tail = b[-1] << 8 | (b[-2] if len(b) > 1 else 0)
            out.append((k if k < len(self.rank) else len(self.rank) + 1 + tail) + 1)
        return out

    def slots(self, text):
        """For each bit of each token: (node, bit, gate, slot of each context)."""
        symbols, seen, out = self.symbols(text), self.seen(text), []
        for i, k in enumerate(symbols):
            last, before = (seen[i - 1] if i else 0), (seen[i - 2] if i > 1 else 0)
            skips = [seen[j] for j in range(i - 1) if symbols[j] < lm.FREQUENT and symbols[j] != self.code.end]
            contexts = (last * SALTS[0], last * SALTS[1] & MASK ^ mixed(before), (skips[-1] if skips else 0) * SALTS[2])
            hashes = [mixed((c & MASK) + n + 1) >> 32 for n, c in enumerate(contexts)]
            for depth, at in enumerate(range(self.code.first[k], self.code.first[k + 1])):
                node = int(self.code.node[at])
                spots = [((h ^ node * 0x85EBCA6B & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - lm.TABLE_BITS for h in hashes]
                out.append((i, node, int(self.code.bit[at]), min(depth, lm.GATES - 1), spots))
        return out

    def bits(self, text, tables, start, rate):
        out = []
        for n, (_, node, bit, gate, spots) in enumerate(self.slots(text)):
            if n % lm.RUN_BITS == 0:
                weights = np.array(start, float).copy()
            share = float(self.code.share[node])
            x = [math.log(share / (1 - share))] + [math.log((tables[k][s][1] + lm.DRAW * share) / (tables[k][s][0] + lm.DRAW * (1 - share))) for k, s in enumerate(spots)]
            z = float(np.dot(weights[gate], x))
            p = 1 / (1 + math.exp(-z))
            out.append(math.log(p if bit else 1 - p))
            weights[gate] += rate * (bit - p) * np.array(x)
        return out


def corpus(n=60):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    return [" ".join(rng.choices(vocabulary[: rng.randrange(2, 40)], k=rng.randrange(0, 60))) for _ in range(n)]


def test_mixing_against_one_bit_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "RUN_BITS", 64)
    monkeypatch.setattr(lm, "TABLE_BITS", 12)
    texts = corpus()
    count = Counter(w for t in texts for w in [*words(t), ""])
    head = sorted(((w.encode(), n) for w, n in count.items()), key=lambda r: (-r[1], r[0]))[:30]
    code = lm.huffman([w for w, _ in head], [n for _, n in head], sum(count.values()) - sum(n for _, n in head) + 1)
    slow, tables = Slow(code), np.zeros((lm.CONTEXTS, 1 << lm.TABLE_BITS, 2), np.float32)
    for t in texts:
        for _, _, bit, _, spots in slow.slots(t):
            for k, spot in enumerate(spots):
                tables[k, spot, bit] += 1
    raw, at = common.utf8(pa.array(texts))
    s = lm.Slice(code, raw, at)
    fast = np.stack([np.bincount(s.slots(k) * 2 + s.bit, minlength=2 << lm.TABLE_BITS) for k in range(lm.CONTEXTS)])
    assert (fast.reshape(tables.shape) == tables).all()
    start = np.random.default_rng(4).uniform(0, 0.6, (lm.GATES, 1 + lm.CONTEXTS)).astype(np.float32)
    got, _ = lm.mix(s, code, tables, start)
    want = [b for t in texts for b in slow.bits(t, tables, start, lm.RATE)]
    assert got == pytest.approx(np.array(want), rel=2e-4, abs=2e-5)


def plain_refined(rows):
    """Scores by dictionaries, from (held_out, [(context key, segment key)], [log])."""
    count = Counter(k for held, keys, _ in rows if not held for pair in keys for k in pair)
    out = []
    for held, keys, logs in rows:
        total, latest = 0.0, []
        for (context, segment), own in zip(keys, logs):
            n, m = (count[k] - (not held) for k in (context, segment))
            if n <= 0:
                total += own
                continue
            q = min(max(m, 0) / n, 1)
            trust = (lm.RIGHT + sum(latest[-lm.WINDOW :])) / (lm.RIGHT + lm.WRONG + len(latest[-lm.WINDOW :]))
            p = math.exp(own)
            total += math.log(trust * q + (1 - trust) * p)
            latest.append(q / (q + p))
        out.append(total)
    return out


@pytest.mark.parametrize("shard", [3, 10**6])
def test_segments_against_dictionaries(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD_KEYS", shard)
    rng = random.Random(8)
    rows = []
    for k in range(40):
        keys = [(rng.randrange(6), 100 + rng.randrange(9)) for _ in range(rng.randrange(1, 50))]
        rows.append((k % 4 == 1, keys, [float(np.float32(-rng.uniform(0.1, 9))) for _ in keys]))
    table = [(k, k, held, 1, 1, 1, 0.0, k // 7, np.array(keys, "<u8").tobytes(), np.array(logs, "<f4").tobytes()) for k, (held, keys, logs) in enumerate(rows)]
    scored = spark.createDataFrame(table, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, n_bytes long, base double, chunk long, keys binary, logs binary").repartition(3)
    got = {r.doc_id: r.mixed for r in lm.refined(scored, lm.segment_counts(scored)).collect()}
    assert [got[k] for k in range(40)] == pytest.approx(plain_refined(rows), rel=1e-9)


def test_segments_are_cut_by_content():
    code = lm.huffman([b"", *(b"w%d" % k for k in range(50))], [60, *([10] * 50)], 1)
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(120))
    texts = [passage, "w1 w2 w3 " + passage, passage + " w4", "w9 " * 31 + passage]
    raw, at = common.utf8(pa.array(texts))
    s = lm.Slice(code, raw, at)
    keys, values, edge = s.segments(np.ones(len(s.bit)))
    sets = [{tuple(k) for k in keys[a:b]} for a, b in zip(edge, edge[1:])]
    assert values.sum() == len(s.bit) and len(sets[0]) > 4
    assert all(len(x & sets[0]) >= len(sets[0]) - 3 for x in sets[1:])


def test_copies_are_told_from_texts_that_occur_once(spark):
    rng = random.Random(6)
    once = [" ".join(f"w{rng.randrange(400)}" for _ in range(150)) for _ in range(120)]
    twice = [" ".join(f"w{rng.randrange(400)}" for _ in range(150)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate([*once, *twice, *twice])]
    got = {r.doc_id: r for r in lm.score_documents(docs(spark, rows)).collect()}
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    alone = [got[k].bits_per_byte for k in range(120)]
    pairs = [(k, k + 20) for k in range(120, 140) if not (held[k] and held[k + 20])]
    copies = [got[k].bits_per_byte for p in pairs for k in p if not held[p[1] if k == p[0] else p[0]]]
    assert len(copies) > 25 and max(copies) < min(alone) / 2


def test_head_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_BYTES", 40)
    rows = [(k, " ".join(["common"] * 9 + ["x" * 300] * 8 + [f"word{k % 5}"] * 3)) for k in range(40)]
    counts = lm.token_counts(docs(spark, rows).select("text"))
    head = lm.head_of(counts)
    assert [w for w, _ in head][:1] == [b"common"] and b"" in [w for w, _ in head] and sum(len(w) for w, _ in head) <= 40
    assert all(r.score < 0 for r in lm.score_documents(docs(spark, rows)).collect())


def test_no_choice_of_rows_decides_a_score(spark):
    """The same texts under other ids of the same folds have the same scores: nothing is learned from rows that their ids pick."""
    rng = random.Random(9)
    texts = [" ".join(f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randrange(1, 30))) for _ in range(900)]
    learned = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 7 != 2]
    a, b = ({texts.index(r.t): r.score for r in lm.score_documents(docs(spark, list(zip(ids, texts)))).join(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, t string"), "doc_id").collect()} for ids in (learned[:900], learned[-900:]))
    assert a.keys() == b.keys() and [a[k] for k in sorted(a)] == pytest.approx([b[k] for k in sorted(a)], rel=1e-6)


def test_bits_of_a_code_are_one_number():
    code = lm.huffman([b"", b"a", b"bb", b"c"], [10, 6, 3, 1], 2)
    assert code.bits.dtype == np.int32 and len(code.bits) == code.first[-1]
    assert ((code.node << 5 | code.gate << 1 | code.bit) == code.bits).all() and set(code.bit.tolist()) == {0, 1}
    assert code.gate.tolist() == [k for n in np.diff(code.first) for k in range(n)] and code.node.max() < len(code.share)
    assert code.drawn[:, 1] == pytest.approx(lm.DRAW * code.share)


def random_slice(n=400, seed=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 900))) for _ in range(n)]
    code = lm.huffman([b"", *(w.encode() for w in vocabulary)], [n, *range(3000, 0, -1)], 5)
    raw, at = common.utf8(pa.array(texts))
    return lm.Slice(code, raw, at), code, np.random.default_rng(seed).integers(0, 30, (lm.CONTEXTS, 1 << lm.TABLE_BITS, 2)).astype(np.float32)


def test_mixing_holds_features_of_some_bits_at_a_time(monkeypatch):
    """Memory beside the slice is a few bytes a bit (it was ninety), and blocks of turns don't show in the result."""
    s, code, tables = random_slice()
    start = np.tile(np.array(lm.WEIGHTS, np.float32), (lm.GATES, 1))
    tracemalloc.start()
    whole, after = lm.mix(s, code, tables, start)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(whole) > 20 * lm.MIXED_BITS and peak < 24 * len(whole)
    monkeypatch.setattr(lm, "MIXED_BITS", 1)
    again, after_again = lm.mix(s, code, tables, start)
    assert (whole == again).all() and (after == after_again).all()


def test_marks_are_slots_and_bits():
    s, _, _ = random_slice(20)
    for k, marks in enumerate(s.marks()):
        assert (marks == s.slots(k) * 2 + s.bit).all()


def test_words_of_many_slices_are_counted_at_once(spark, monkeypatch):
    """However much text is counted at once, the counts are those of plain loops."""
    texts = [" ".join(f"W{(k * j) % 97}" for j in range(50)) for k in range(200)] + ["", " \t", None]
    want = Counter(w.encode() for t in texts for w in [*words(t or ""), ""])
    rows = docs(spark, list(enumerate(texts))).select("text").coalesce(1)
    for limit in (1, 1 << 12, 32 << 20):
        monkeypatch.setattr(lm, "COUNT_BYTES", limit)
        assert {bytes(r.token): r.n for r in lm.token_counts(rows).collect()} == want
    assert lm.token_counts(docs(spark, []).select("text")).collect() == []
