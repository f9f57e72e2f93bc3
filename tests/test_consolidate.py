"""Consolidation runs: counters, dry runs, watermarks, edits, overrides and runs that died."""

import pytest

from mnemospark.operators import consolidate as O
from mnemospark.sources.manifest import Manifests
from mnemospark.storage import shared_folder

SCHEMA = "event_id string, kind string, topic_key string, claim_subject string, value string, ts double, supersedes_event_id string, schema_version int"


def event(n, value, ts, kind="observation", target=None, topic="t1", version=1):
    return (f"e{n:02d}", kind, topic, "s", value, ts, target, version)


FIRST = [
    event(1, "blue", 1.0), event(2, "red", 2.0), event(3, "red", 3.0), event(4, "green", 3.0), event(5, "x", 1.0, topic="t2"), event(6, "y", 5.0, topic="t2"),
    event(7, "gone", 6.0, O.DELETED, "e06", "t2"), event(8, "", 1.0), event(9, "z", None), event(10, "z", 1.0, version=2), event(11, "no target", 6.0, O.DELETED),
]
SECOND = [event(12, "blue", 9.0), event(13, "fixed", 8.0, O.EDITED, "e05", "t2"), event(14, "late", 2.5)]


@pytest.fixture
def memory(spark):
    return O.Memory(spark, f"{shared_folder(spark)}/memory")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def state(memory):
    rows = memory.claims.rows()
    stance = {r.source_event_id: r.stance for r in O.C.elect(rows.drop("retracted"), rows.where("retracted")).collect()}
    by_claim = {r.claim_id: r.source_event_id for r in rows.collect()}
    log = sorted((r.event_type, by_claim[r.claim_id], by_claim.get(r.new_claim_id), r.reason) for r in memory.log.rows().collect() if r.event_type != "assert")
    return stance, log


def test_two_runs(spark, memory):
    rows = frame(spark, FIRST)
    dry = O.consolidate(memory, rows, dry_run=True)
    assert memory.watermark() is None and memory.claims.manifests.latest() == memory.log.manifests.latest() == 0
    one = O.consolidate(memory, rows)
    assert one == dry | {"projection_written": 2} and one["events_total"] == 11
    assert {k: one[f"events_{k}"] for k in ("conforming", "skipped_future_schema", "skipped_missing_required", "skipped_unparseable_ts")} == {"conforming": 8, "skipped_future_schema": 1, "skipped_missing_required": 2, "skipped_unparseable_ts": 1}
    stance, log = state(memory)
    assert stance == {"e01": "superseded", "e02": "superseded", "e03": stance["e03"], "e04": stance["e04"], "e05": "current", "e06": "tombstone"} and {stance["e03"], stance["e04"]} == {"current", "superseded"}
    newer = "newer_source_ts"
    assert log == sorted([("supersede", "e01", "e02", newer), ("supersede", "e04", "e02", newer), ("supersede", "e05", "e06", newer), ("retract", "e06", None, "tombstone_deleted")]) or ("supersede", "e04", "e03", newer) in log
    assert memory.watermark() == {"ts": 6.0, "tombstone": 1, "event_id": "e11"}
    two = O.consolidate(memory, frame(spark, FIRST + SECOND))
    assert (two["events_total"], two["events_conforming"], two["claims_asserted"]) == (14, 2, 2)  # what is not after the watermark is dropped
    stance, log = state(memory)
    assert stance["e12"] == "current" and stance["e13"] == "current" and "e14" not in stance
    assert ("supersede", "e05", "e13", "tombstone_edited") in log and ("supersede", "e05", "e13", newer) not in log
    assert two["projection_written"] == 2 and two["re_election_supersedes"] == 2
    before = memory.watermark()
    three = O.consolidate(memory, frame(spark, FIRST + SECOND))
    assert three["events_conforming"] == 0 and three["projection_unchanged"] == 2 and memory.watermark() == before and memory.marks.latest() == 2


def test_overrides_and_restores(spark, memory):
    O.consolidate(memory, frame(spark, FIRST))
    ids = {r.source_event_id: r.claim_id for r in memory.claims.rows().collect()}
    log = spark.createDataFrame([(1, "retract", "event_id", "e03"), (2, "retract", "claim_id", ids["e04"]), (3, "retract", "claim_id", ids["e05"]), (4, "restore", "claim_id", ids["e05"])], "ord long, op string, key_type string, key string")
    got = O.consolidate(memory, frame(spark, []), overrides=log)
    assert got["overrides_applied"] == got["retracts_appended"] == 2 and got["re_election_supersedes"] == 1
    stance, _ = state(memory)
    assert {k: stance[k] for k in ("e02", "e03", "e04", "e05")} == {"e02": "current", "e03": "tombstone", "e04": "tombstone", "e05": "current"}
    assert O.consolidate(memory, frame(spark, []), overrides=log)["overrides_applied"] == 0


def test_a_run_that_died_is_run_again(spark, memory, monkeypatch):
    rows = frame(spark, FIRST)
    commit = Manifests.commit
    monkeypatch.setattr(Manifests, "commit", lambda self, version, content: (_ for _ in ()).throw(RuntimeError("gone")) if self.folder.endswith(("marks", "projection")) else commit(self, version, content))
    with pytest.raises(RuntimeError):
        O.consolidate(memory, rows)
    monkeypatch.undo()
    assert memory.watermark() is None
    O.consolidate(memory, rows)
    other = O.Memory(spark, f"{shared_folder(spark)}/memory")
    O.consolidate(other, rows)
    assert sorted(memory.claims.rows().collect()) == sorted(other.claims.rows().collect())
    assert sorted(map(repr, memory.log.rows().collect())) == sorted(map(repr, other.log.rows().collect()))


def test_the_input_is_read_once(spark, memory):
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(len(b))
            yield b

    O.consolidate(memory, frame(spark, FIRST).mapInPandas(count, SCHEMA))
    assert met.value == len(FIRST)


def test_empty(spark, memory):
    assert not any(O.consolidate(memory, frame(spark, [])).values()) and memory.watermark() is None
