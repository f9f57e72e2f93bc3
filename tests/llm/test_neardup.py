import random

import corpus_pipeline
from mnemospark.llm import neardup

from .helpers import ODD, docs, words


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(rows, threshold=0.8):
    """The groups of row numbers, by all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or len(x & y) >= threshold * len(x | y) - 1e-9:
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(rows))]


def partition(pairs):
    out = {}
    for name, member in pairs:
        out.setdefault(name, set()).add(member)
    return {frozenset(v) for v in out.values()}


def edited(rng):
    """Texts of 60 to 300 words, copies of them with scattered word edits, and a chain of edits."""
    rows = []
    for base in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        rows.append(" ".join(w))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            rows.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < share else x for x in w))
    w = [f"c{k}" for k in range(200)]
    for k in range(60):
        w[rng.randrange(200)] = f"d{k}"
        rows.append(" ".join(w))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [passage + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(40)) for _ in range(30)]
    return list(enumerate(rows))


def test_edited_texts_against_all_pairs(spark, sf):
    rows = edited(random.Random(5))
    expected = partition((g, k) for g, (k, _) in zip(brute_groups(rows), rows))
    table = docs(spark, rows)
    assert partition((r["__component"], r.doc_id) for r in neardup.near_duplicates(table).collect()) == expected
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, sf).collect()} == {min(g) for g in expected}


def test_buckets_of_several_trees_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TREE_SHINGLES", 400)
    monkeypatch.setattr(neardup, "LANE_PAIRS", 2)
    rows = edited(random.Random(6))
    expected = partition((g, k) for g, (k, _) in zip(brute_groups(rows), rows))
    assert partition((r["__component"], r.doc_id) for r in neardup.near_duplicates(docs(spark, rows)).collect()) == expected


def test_a_large_group_of_near_copies_makes_few_rows(spark, monkeypatch):
    """Copies of one text that are often further apart than the threshold from each other, but not from the text."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(200)]
    rows = [(k, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.018 else x for x in base)) for k in range(400)] + [(400, " ".join(base))]
    made = []
    monkeypatch.setattr(neardup, "across", lambda *a, f=neardup.across: made.append(f(*a).cache()) or made[-1])
    got = partition((r["__component"], r.doc_id) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert got == partition((g, k) for g, (k, _) in zip(brute_groups(rows), rows))
    assert sum(x.count() for x in made) < 25 * len(rows)


def test_odd_rows(spark):
    got = neardup.near_duplicates(docs(spark, ODD, extra=True)).collect()
    assert partition((r["__component"], r.doc_id) for r in got) == partition((g, k) for g, (k, _) in zip(brute_groups(ODD), ODD))
    assert len(got) == len(ODD) and neardup.near_duplicates(docs(spark, [])).count() == 0


def test_stage_over_a_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").cache()
    rows = [(r.doc_id, r.text) for r in table.collect()]
    expected = partition((g, k) for g, (k, _) in zip(brute_groups(rows), rows))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, sf).collect()} == {min(g) for g in expected}


def test_fingerprints_within_the_radius_are_candidates(spark):
    """The BK-trees' components are buckets of their own, and what is in them is verified."""
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    near, other = [*long[:300], "x", *long[301:]], [f"v{rng.randrange(5000)}" for _ in range(600)]
    rows = [(k, " ".join(t)) for k, t in enumerate((long, near, other))]
    table = docs(spark, rows)
    prints = neardup.print_table(table, "doc_id", "text", 5)
    buckets = {r.node: r.band for r in neardup.fingerprint_buckets(prints, 4).collect()}
    node = {r.doc_id: r.node for r in prints.collect()}
    assert len(set(node.values())) == 3 and buckets[node[0]] == buckets[node[1]] != buckets[node[2]]
    assert partition((r["__component"], r.doc_id) for r in neardup.near_duplicates(table).collect()) == {frozenset({0, 1}), frozenset({2})}
