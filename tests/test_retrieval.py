"""BM25, ranks and vectors against plain loops, in blocks of every size."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions.text import STOP_TERMS
from mnemospark.operators import retrieval


def terms(s):
    return [t for t in re.findall(r"[a-z0-9_]+", (s or "").lower()) if len(t) > 1 and t not in STOP_TERMS]


def plain(docs, queries):
    """(score, path) of all hits of each query, best first."""
    bags = {p: Counter(terms(b)) for p, b in docs}
    n, mean = len(docs), sum(sum(b.values()) for b in bags.values()) / len(docs)
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for q, text in queries:
        found = []
        for p, b in bags.items():
            s = sum(k * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, k in Counter(terms(text)).items() if b[t])
            if round(s, 6) > 0:
                found.append((-round(s, 6), p))
        out[q] = sorted(found)
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "a", "x"]
    docs = [(f"p{k:03d}", " ".join(rng.choices(vocabulary[: rng.randrange(3, 63)], k=rng.randrange(0, 40)))) for k in range(120)]
    docs += [(f"copy{k}", docs[7][1]) for k in range(30)] + [("null", None), ("empty", "")]
    queries = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for k in range(25)] + [(50, "unheard words only"), (51, docs[7][1])]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return docs, queries, frame(docs, "path string, body string"), frame(queries, "qid long, query string")


@pytest.mark.parametrize("block, pairs, rows", [(4096, 10**6, 256), (4, 10**6, 7), (4096, 40, 1)])
def test_bm25_and_standing(spark, made, monkeypatch, block, pairs, rows):
    for name, value in (("BLOCK", block), ("BLOCK_TERMS", pairs), ("ROWS", rows)):
        monkeypatch.setattr(retrieval, name, value)
    docs, queries, d, q = made
    want = plain(docs, queries)
    got = {}
    for r in retrieval.bm25(d, q, 8).collect():
        got.setdefault(r.qid, []).append((r["rank"], -r.score, r.path))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(n + 1, s, p) for n, (s, p) in enumerate(v[:8])] for k, v in want.items() if v}
    rng = random.Random(5)
    support = sorted({(k, rng.choice(docs)[0]) for k, _ in queries for _ in range(3)})
    size = {p: len(b or "") for p, b in docs}
    rank = {(k, p): n for k, v in want.items() for n, (_, p) in enumerate(v, 1)}
    expected = {}
    for k in {k for k, _ in support}:
        best = min((rank[k, p] for j, p in support if j == k and (k, p) in rank), default=None)
        expected[k] = (best, None if best is None else sum(size[p] for _, p in want[k][:best]))
    found = retrieval.standing(d, q, spark.createDataFrame(support, "qid long, path string"), F.coalesce(F.length("body"), F.lit(0)))
    assert {r.qid: (r.best, r.depth) for r in found.collect()} == expected


def test_no_queries_and_no_documents(spark, made):
    _, _, d, q = made
    none = spark.createDataFrame([], "qid long, path string")
    assert retrieval.bm25(d, q.limit(0), 5).count() == 0 and retrieval.bm25(d.limit(0), q, 5).count() == 0
    assert retrieval.standing(d, q, none, F.lit(1)).count() == 0
    assert [tuple(r) for r in retrieval.standing(d.limit(0), q, spark.createDataFrame([(1, "p000")], "qid long, path string"), F.lit(1)).collect()] == [(1, None, None)]


@pytest.mark.parametrize("block, rows", [(4096, 256), (3, 5)])
def test_vectors_with_ties(spark, monkeypatch, block, rows):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "ROWS", rows)
    rng = np.random.default_rng(2)
    vectors = [(f"v{k:02d}", rng.normal(size=6).tolist()) for k in range(60)]
    vectors += [(f"t{k:02d}", vectors[3][1]) for k in range(20)] + [("zero", [0.0] * 6), ("none", None)]
    queries = [(k, vectors[k][1]) for k in range(10)]
    unit = {p: np.array(v) / max(np.linalg.norm(v), 1e-12) for p, v in vectors if v is not None}
    want = {(k, n + 1): p for k, v in queries for n, (_, p) in enumerate(sorted((-(round(float(unit[p] @ unit[f"v{k:02d}"]), 6) + 0.0), p) for p in unit)[:7])}
    got = retrieval.dense(spark.createDataFrame(vectors, "path string, embedding array<double>").repartition(3), spark.createDataFrame(queries, "qid long, embedding array<double>"), 7)
    assert {(r.qid, r["rank"]): r.path for r in got.collect()} == want


@pytest.mark.parametrize("block, pairs, rows", [(4096, 10**6, 256), (3, 10**6, 7), (4096, 30, 4)])
@pytest.mark.parametrize("jaccard", [False, True])
def test_overlap(spark, monkeypatch, block, pairs, rows, jaccard):
    for name, value in (("BLOCK", block), ("BLOCK_TERMS", pairs), ("ROWS", rows)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(6)
    words = ["the", *[f"w{k}" for k in range(30)], "\u00e9t\u00e9", "e\u0301"]
    bag = lambda: ["the"] * rng.randrange(3) + rng.choices(words, k=rng.randrange(9))
    docs = [(f"d{k:03d}", bag(), [rng.choice(words), "w1", "w1"]) for k in range(80)] + [("null", None, None), ("empty", [], ["w2"])]
    queries = [(k, bag()) for k in range(20)] + [(30, None), (31, ["unheard"]), (32, words * 3)]
    want = set()
    for q, x in queries:
        found = []
        for p, y, tags in docs:
            common, union = len(set(x or ()) & set(y or ())), len(set(x or ()) | set(y or ()))
            score = round((common / union if jaccard else common) + min(0.5, 0.3 * len(set(x or ()) & set(tags or ()))), 6) if common else 0.0
            if common and score >= 0.1:
                found.append((-score, p))
        want |= {(q, p, -s, n) for n, (s, p) in enumerate(sorted(found)[:4], 1)}
    d = spark.createDataFrame(docs, "path string, words array<string>, tags array<string>").repartition(3)
    q = spark.createDataFrame(queries, "qid long, words array<string>")
    got = [tuple(r) for r in retrieval.overlap(d, q, 4, jaccard, least=0.1, boost=0.3, most=0.5).select("qid", "path", "score", "rank").collect()]
    assert len(got) == len(want) and set(got) == want
    assert retrieval.overlap(d, q.limit(0), 4).count() == 0 and retrieval.overlap(d.limit(0), q, 4).count() == 0


def test_a_long_query_makes_only_its_own_block_small(spark, monkeypatch):
    """Blocks are cut by the running number of terms; every row is in one of them."""
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 100)
    sizes = [3] * 10 + [250] + [3] * 40
    terms = spark.createDataFrame([(q, f"t{k}", 1.0) for q, n in enumerate(sizes) for k in range(n)], "qid long, term string, w double")
    blocks = list(retrieval.Asked(terms).blocks())
    assert [b.queries for b in blocks] == [10, 1, 33, 7] and [b.first for b in blocks] == [1, 11, 12, 45]
    assert [int(b.sizes.sum()) for b in blocks] == [30, 250, 99, 21]


def test_frequent_terms_are_scored_in_bounded_memory():
    """256 documents and 1000 queries that share all of 50 terms have 12.8 million parts of scores, of which a task holds a few at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, term = np.repeat(np.arange(1, 1001), 50), [f"t{k:02}" for k in range(50)]
    block = retrieval.Block(pa.table({"n": pa.array(n), "term": pa.array(term * 1000), "w": pa.array(np.ones(50_000))}), 1, 1000)
    tracemalloc.start()
    sums = list(block.sums(pa.array([term] * 300), lambda tf, size: np.ones(len(tf))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(low, high) for low, high, _ in sums] == [(0, 256), (256, 300)] and all((v == 50).all() for *_, v in sums)
    assert peak < 120e6


@pytest.mark.parametrize("cells", [7, 131_072])
def test_frequent_terms_are_added_up_by_a_product(monkeypatch, cells):
    """Terms that many of a block's queries have make no parts of scores of their own; sums are those of plain loops. A query's term may come twice."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "CELLS", cells)
    queries = [{"all": 2.0, "half": 1.5} if q % 2 else {"all": 1.0, f"own{q}": 3.0} for q in range(100)]
    rows = [(q + 1, t, w) for q, terms in enumerate(queries) for t, w in terms.items()] + [(1, "all", 0.5)]
    block = retrieval.Block(pa.table({"n": [r[0] for r in rows], "term": [r[1] for r in rows], "w": [r[2] for r in rows]}), 1, 100)
    bags = [["all", "all", "own4", "none"], [], None, ["half"], ["own0", "own98", "half", "all"]]
    column, matrix = block.frequent()
    assert [t for t, c in zip(block.terms.to_pylist(), column) if c >= 0] == ["all", "half"] and matrix.shape == (2, 100)
    got = np.concatenate([v for _, _, v in block.sums(pa.array(bags, pa.list_(pa.string())), lambda tf, size: tf.astype(float))])
    want = [[sum((bag or []).count(t) * w for n, t, w in rows if n == q + 1) for q in range(100)] for bag in bags]
    assert np.allclose(got, want)


def test_legs_of_hybrid_queries_leave_texts_unjoined(spark, sf, monkeypatch):
    """Texts are read without their labels: no join moves them."""
    from mnemospark import views
    from mnemospark.plans import retrieval as queries

    monkeypatch.setattr(views, "memory_docs", None)
    assert queries.legs(spark, sf).columns == ["qid", "variant", "path", "rank"]
