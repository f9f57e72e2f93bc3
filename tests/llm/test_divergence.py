import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import divergence

from . import helpers

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    """The contract word for word: every share of every kept term in every group."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {k[0] for k in groups}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        of = {s: {t: c[t] for t in kept} for (k, s), c in groups.items() if k == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}
        share = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s in of:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in of if o != s))
            terms = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


ROWS = [
    (k, f"{'alpha ' * (k % 5)}Beta-gamma {'δέλτα 日本' * (k % 3)} x{k % 7}y {'only' + 'abc'[k % 3] if k % 4 else ''}", ["en", "de", None, ""][k % 4], ["s1", "s2", "s3", None, "sé4"][k * 7 % 5])
    for k in range(80)
] + [(90, None, "en", "empty"), (91, "", "xx", "a"), (92, "1 2 3", "xx", "b"), (93, "alpha " * 30_000, "en", "long"), (4, None, None, None), (4, None, None, None)]


@pytest.mark.parametrize("min_docs,top", [(3, 50), (1, 2), (10, 50), (1000, 50)])
def test_equals_all_shares(spark, min_docs, top):
    got = divergence.audit(helpers.docs(spark, ROWS, extra=True), min_docs, top)
    assert sorted(map(tuple, got.collect())) == brute(ROWS, min_docs, top)


def test_empty_table(spark):
    assert divergence.audit(helpers.docs(spark, [])).collect() == []


def test_equals_its_sql(spark, sf):
    from tests.oracle import connect, same

    from mnemospark.llm import queries

    same(queries.QUERIES["op13_divergence"](spark, sf), connect(sf), queries.ORACLE_SQL["op13_divergence"])


def test_counts_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**15, 3 * 10**15, 10**6)], "c long, n long, v long")
    assert rows.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**6)


def test_plan(spark, sf):
    plan = divergence.audit(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
