import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import decontam, linededup, queries, simhash

from .helpers import ODD, docs, words


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, min_docs):
    count = Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[line_key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("extra", [False, True])
def test_lines_odd_rows(spark, extra):
    got = linededup.line_report(docs(spark, ODD, extra), min_docs=2).collect()
    assert order(map(tuple, got)) == order(brute_lines(ODD, 2))
    assert linededup.line_report(docs(spark, []), 2).count() == 0


def test_op3_over_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert order(map(tuple, queries.op3_line_dedup(spark, sf).collect())) == order(brute_lines(rows, 10))


def test_copies_may_count_once_and_columns_stay(spark):
    rows = [(k, "same\nlines") for k in range(5)] + [(9, "same\nother"), (10, "SAME \nthird")]
    df = docs(spark, rows, extra=True)
    out = linededup.drop_common_lines(df, min_docs=3, count_copies=False)
    assert out.drop("__n_lines", "__n_dropped").columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {**{k: "lines" for k in range(5)}, 9: "other", 10: "third"}
    out = linededup.drop_common_lines(df, min_docs=5)
    assert {r.text for r in out.collect()} == {"", "other", "third"}


def brute_fingerprint(text, width=4):
    w = words(text)
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for k in range(len(prints)):
        groups.setdefault(root(k), []).append(k)
    out = []
    for members in groups.values():
        ids = [prints[k][0] for k in members if prints[k][0] is not None]
        out += [(prints[k][0], f"{prints[k][1]:016x}", min(ids) if ids else None) for k in members]
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_near_duplicates_odd_rows(spark, extra):
    got = simhash.near_duplicates(docs(spark, ODD, extra)).select("doc_id", "fingerprint", "component_id").collect()
    assert order(map(tuple, got)) == order(brute_components([(d, brute_fingerprint(t)) for d, t in ODD]))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_op4_over_the_whole_table(spark, sf):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert order(map(tuple, queries.op4_simhash(spark, sf).collect())) == order(brute_components(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 12))
def test_bk_tree_finds_all_within_the_radius(values, radius):
    values = [v & 0xFF0000000000F00F for v in values]
    values = list(dict.fromkeys(values))
    tree = simhash.BKTree(np.array(values, np.uint64))
    q, node = (np.concatenate(x) for x in zip(*tree.search(np.array(values, np.uint64), radius)))
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= radius}
    assert sorted(zip(q.tolist(), node.tolist())) == sorted(want)
    # children of one node have distinct distances
    assert len(set(zip(tree.parent[1:].tolist(), tree.edge[1:].tolist()))) == len(values) - 1


def test_masks_miss_no_pair():
    rng = np.random.default_rng(1)
    levels = simhash.shard_masks(4, 2, 2)
    assert [len(x) for x in levels] == [15, 225, 3375] and all(len(set(x)) == len(x) for x in levels[:1])
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= 1 << int(k)
        level = range(15)
        for depth, masks in enumerate(levels):
            # within every shard that both are in, they share a finer one
            assert all(any((a ^ b) & masks[k] == 0 for k in group) for group in ([range(15)] if depth == 0 else [range(15 * p, 15 * p + 15) for p in level]))
            level = [k for k in range(len(masks)) if (a ^ b) & masks[k] == 0]


@pytest.mark.parametrize("size", [4, 16])
def test_links_of_split_shards_and_long_chains(spark, monkeypatch, size):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62)
    near = {int(base) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (300, 3))}
    chain, x = [], 0
    for k in range(0, 60, 4):
        x ^= 0xF << k
        chain.append(x)
    values = sorted(near | set(chain) | {int(v) for v in rng.integers(0, 2**62, 200)})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    monkeypatch.setattr(simhash, "SHARD_NODES", size)
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4).selectExpr("fp a", "root b")).collect()}
    got = {}
    for v in values:
        got.setdefault(roots.get(v, v), set()).add(v)
    want = {}
    for v, _, c in brute_components([(v, v) for v in values]):
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_contained(rows, items, threshold=0.8, width=5):
    out = []
    for item, text in items:
        want = shingles(text, width)
        if not want:
            continue
        size = min(width, len(words(text)))
        for d, t in rows:
            w = words(t)
            own = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            n = len(want & own)
            if n >= threshold * len(want) - 1e-9:
                out.append((d, item, len(want), n))
    return out


ITEMS = [(1, "a b c d e f g"), (2, "The Quick brown  fox jumps OVER the lazy dog"), (3, None), (4, ""), (5, "one"), (6, "one"), (7, "jumps over the"), (None, "null id text"), (8, "word word word word word word")]


@pytest.mark.parametrize("block", [10**6, 6])
def test_contained_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contained(docs(spark, ODD, extra=True), items)
    got = [tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_found").collect()]
    assert order(got) == order(brute_contained(ODD, ITEMS))
    assert decontam.contained(docs(spark, []), items).count() == 0
    assert decontam.contained(docs(spark, ODD), items.limit(0)).count() == 0


def test_items_with_a_fifth_of_their_shingles_changed_are_found(spark):
    item = [f"w{k}" for k in range(64)]  # 60 shingles
    changed = ["filler"] * 3000 + item[:20] + ["x"] + item[21:40] + ["y"] + item[41:] + ["end"] * 2000
    less = item[:20] + ["x"] + item[21:40] + ["y"] + item[41:50] + ["z"] + item[51:]
    rows = [(1, " ".join(changed)), (2, " ".join(less)), (3, "nothing here")]
    got = decontam.contained(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert [tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_found").collect()] == brute_contained(rows, [(1, " ".join(item))])


def test_op6_over_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op6_decontamination(spark, sf).select("doc_id", "item_id", "n_shingles", "n_found").collect()
    want = brute_contained(rows, items)
    assert want and order(map(tuple, got)) == order(want)
