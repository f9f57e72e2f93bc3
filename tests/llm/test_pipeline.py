from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from mnemospark.llm import queries

from .helpers import CLASHING, ODD, docs
from .test_lines_and_duplicates import brute_contained, line_key
from .test_neardup import brute_groups, partition


def test_stages_in_order_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-duplicates", "decontamination", "packing"]
    registered = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in registered if k.startswith("op")} and "pipeline" in registered
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_each_stage_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, sf)
        assert now.columns == table.columns
        now = now.cache()
        after = {r.doc_id: r for r in now.collect()}
        if name == "language ID":
            assert len(after) >= 0.98 * len(before) and all(before[k] == r for k, r in after.items())
        elif name == "line dedup":
            count = {}
            for t in {r.text for r in before.values()}:
                for k in {line_key(x) for x in t.split("\n")}:
                    count[k] = count.get(k, 0) + 1
            for k, r in before.items():
                kept = [x for x in r.text.split("\n") if not line_key(x) or count[line_key(x)] < 10]
                assert after[k].text == "\n".join(kept) and after[k].n_chars == len(after[k].text)
        elif name == "near-duplicates":
            rows = [(k, r.text) for k, r in before.items()]
            groups = partition((g, k) for g, (k, _) in zip(brute_groups(rows), rows))
            assert set(after) == {min(g) for g in groups} and all(before[k] == r for k, r in after.items())
        else:
            bad = {d for d, *_ in brute_contained([(k, r.text) for k, r in before.items()], items)}
            assert set(after) == set(before) - bad
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after)


def test_odd_rows_pass_all_stages(spark, sf):
    now = docs(spark, ODD, extra=True)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if stage is not corpus_pipeline.pack:
            assert len(now.columns) == 5 + len(CLASHING)
            kept = {(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()}
            assert (10, ODD[11][1]) in kept and (14, "Ünïcode Ça va? ΑΣ") in kept
    pieces = now.select("doc_id", "doc_tokens", "length").collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in kept}
    now = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0


def test_repeated_rows_become_one(spark, sf):
    rows = docs(spark, [(4, "one two three four five six"), (4, "one two three four five six"), (7, "entirely other words stand here now")])
    kept = corpus_pipeline.drop_near_duplicates(spark, rows, sf)
    assert sorted(r.doc_id for r in kept.select(F.col("doc_id")).collect()) == [4, 7]
