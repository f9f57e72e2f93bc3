"""The keyed table against a dictionary, through rounds, conflicts and retries."""

import random

import pytest

from mnemospark.sources.manifest import Manifests
from mnemospark.sources.store import Store
from mnemospark.storage import shared_folder

SCHEMA = "k string, v long, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def store(spark):
    return Store(spark, f"{shared_folder(spark)}/s", frame(spark, []).schema, "k", buckets=5)


def held(store, version=None):
    return {r.k: (r.v, r.note) for r in store.rows(version).collect()}


def test_rounds_equal_a_dictionary(spark, store):
    rng, want = random.Random(3), {}
    for step in range(5):
        rows = {f"k{rng.randrange(30)}": (rng.randrange(3), rng.choice(["x", None, ""])) for _ in range(12)}
        data = frame(spark, [(k, *v) for k, v in rows.items()])
        changed = sum(want.get(k) != v for k, v in rows.items())
        if step % 3 == 2:
            gone = sum(k not in rows for k in want)
            assert store.sync(data) == {"written": changed, "deleted": gone, "kept": len(rows) - changed}
            want = rows
        else:
            count = store.upsert(data)
            assert (count["written"], count["deleted"]) == (changed, 0)
            want = want | rows
        assert held(store) == want


def test_nothing_to_do_writes_nothing(spark, store):
    data = frame(spark, [("a", 1, None), ("b", None, ""), ("a", 1, None), (None, 4, "no key")])
    assert store.upsert(data)["written"] == 2 and held(store) == {"a": (1, None), "b": (None, "")}
    before = store.manifests.latest()
    for again in (store.upsert, store.sync):
        assert again(data)["kept"] == 2
    assert store.delete(frame(spark, [("zz", 1, "")]))["deleted"] == 0
    assert store.manifests.latest() == before == 1


def test_only_touched_buckets_are_written_anew(spark, store):
    store.upsert(frame(spark, [(f"k{k}", k, "") for k in range(40)]))
    first = store.manifests.read(1)["buckets"]
    store.upsert(frame(spark, [("k7", 70, "")]))
    second = store.manifests.read(2)["buckets"]
    assert len(first) == 5 and sum(first[b] != second[b] for b in first) == 1
    assert held(store)["k7"] == (70, "") and held(store, 1)["k7"] == (7, "")
    assert store.vacuum() == [] and store.delete(frame(spark, [(f"k{k}", 0, "") for k in range(40)]))["deleted"] == 40
    assert held(store) == {} and len(store.vacuum()) == 3  # the last holds the buckets that were left empty


def test_two_writers_lose_nothing(spark, store, monkeypatch):
    """The second writer begins before the first has committed, on one bucket and on others."""
    store.upsert(frame(spark, [("a", 1, "")]))
    commit, late = Manifests.commit, []

    def another_first(self, version, content):
        if not late:
            late.append(version)
            store.upsert(frame(spark, [("b", 2, ""), ("a", 5, "first")] + [(f"o{k}", k, "") for k in range(9)]))
        return commit(self, version, content)

    monkeypatch.setattr(Manifests, "commit", another_first)
    store.upsert(frame(spark, [("c", 3, ""), ("a", 9, "last")]))
    monkeypatch.undo()
    assert held(store) == {"a": (9, "last"), "b": (2, ""), "c": (3, "")} | {f"o{k}": (k, "") for k in range(9)}
    assert store.manifests.latest() == 3


def test_a_writer_that_died_leaves_no_trace(spark, store, monkeypatch):
    store.upsert(frame(spark, [("a", 1, "")]))
    monkeypatch.setattr(Manifests, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        store.upsert(frame(spark, [("a", 2, ""), ("b", 2, "")]))
    monkeypatch.undo()
    assert held(store) == {"a": (1, "")} and len(store.vacuum()) == 1 and held(store) == {"a": (1, "")}


def test_other_columns_and_types(spark, store):
    store.upsert(spark.createDataFrame([("a", 1, "n", "other")], "k string, v int, note string, __bucket string"))
    assert held(store) == {"a": (1, "n")} and store.rows().columns == ["k", "v", "note"]
    assert store.upsert(frame(spark, [])) == {"written": 0, "deleted": 0, "kept": 0}


def test_rows_of_new_buckets_are_written_once(spark, store, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    made, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: made.append(path) or parquet(self, path, *a, **k))
    store.upsert(frame(spark, [(f"k{k}", k, "") for k in range(40)]))
    store.sync(frame(spark, [(f"k{k}", -k, "") for k in range(1, 41)]))
    assert len(made) == 2 and held(store) == {f"k{k}": (-k, "") for k in range(1, 41)}
