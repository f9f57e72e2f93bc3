"""One memory from end to end."""

import pytest
from pyspark.sql import functions as F

from mnemospark import views
from mnemospark.api import Memory


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, f"file://{tmp_path}/memory")


def test_episodes_and_policy(spark, sf, memory):
    e = views.episodes(spark, sf)
    memory.append_episodic("default", e.where("ord < 100"))
    memory.append_episodic("team-a", e.where("ord >= 100"))
    assert memory.episodes("default").count() == 100
    got = {r.namespace: r.episodes for r in memory.stats().collect()}
    assert got == {"default": 100, "team-a": e.count() - 100, "total": e.count()}
    for bad in ("snapshots", "Team", "1x", "a" * 33):
        with pytest.raises(ValueError):
            memory.append_episodic(bad, e)
    memory.write_policy(1, "skill_1", "auto", "ann", "works")
    memory.write_policy(2, "skill_1", "manual", "bob", "rollback")
    assert [tuple(r) for r in memory.read_policy().collect()] == [("skill_1", "manual", "bob", "rollback")]


def test_documents(spark, sf, memory):
    docs = views.memory_docs(spark, sf).withColumn("mtime", F.col("doc_id").cast("double"))
    n = docs.count()
    assert memory.reindex(docs) == {"inserted": n}
    changed = docs.where("doc_id <> 3").withColumn("mtime", F.when(F.col("doc_id") == 5, -1.0).otherwise(F.col("mtime")))
    assert memory.reindex(changed) == {"kept": n - 2, "updated": 1, "pruned": 1}
    asked = spark.createDataFrame([(1, "the with"), (2, "nothingmatches")], "qid long, query string")
    rows = memory.query(asked, k=3, type="en").collect()
    assert rows == [] or {r.qid for r in rows} == {1}
    words = docs.where("doc_id = 7").select(F.lit(7).cast("long").alias("qid"), F.substring("body", 1, 200).alias("query"))
    best = memory.query(words, k=3, policy="ignore").orderBy("rank").first()
    assert best.path == "doc/00000007"
    support = spark.createDataFrame([(7, "doc/00000007")], "qid long, path string")
    assert memory.evaluate(words, support).first().recall_1 == 1.0
    assert memory.lint(spark.createDataFrame([], "path string")).count() == 0


def test_claims_are_consolidated_once(spark, sf, memory):
    o = views.observations(spark, sf)
    early, late = o.where("ts < 850000000"), o.where("ts >= 850000000")
    first = memory.consolidate(early)
    assert first["assert"] == early.where("kind <> 'tombstone-deleted'").count()
    assert memory.consolidate(early) == {"assert": 0, "supersede": 0, "retract": 0}
    memory.consolidate(late)
    memory.consolidate(o)
    from mnemospark.operators import claims

    a = claims.extract(o)
    want = {r.claim_id: r.stance for r in claims.elect(a, claims.tombstones(o, a)).collect()}
    assert {r.claim_id: r.stance for r in memory.state().collect()} == want
    current = memory.state().where("stance = 'current'").orderBy("claim_id").first()
    memory.override(1, "retract", "claim_id", current.claim_id)
    assert memory.state().where(F.col("claim_id") == current.claim_id).first().stance == "tombstone"
    memory.override(2, "restore", "claim_id", current.claim_id)
    assert memory.state().where(F.col("claim_id") == current.claim_id).first().stance == "current"
    assert memory.trace(current.claim_id).where("event_type = 'assert'").count() == 1
    with pytest.raises(ValueError):
        memory.override(3, "erase", "claim_id", "x")


def test_pending_candidates(spark, memory):
    c = spark.createDataFrame([("a", 5, 2.0, "2024-01-01"), ("b", 50, 2.0, "2024-01-30"), ("c", 500, 9.0, "2024-01-30")], "id string, cluster_size long, canonical_salience double, staged_at string").withColumn("staged_at", F.col("staged_at").cast("timestamp_ntz"))
    d = spark.createDataFrame([("c", 1, "reject"), ("a", 1, "reject"), ("a", 2, "reopen")], "id string, ord long, action string")
    assert [r.id for r in memory.pending(c, d).collect()] == ["b", "a"]
