"""The stored index against the scan, and its versions."""

import pytest

from mnemospark.operators import retrieval, text_index
from mnemospark.operators.text_index import TextIndex
from mnemospark.sources.manifest import Conflict, Manifests
from mnemospark.storage import shared_folder

from .test_plans import plan_of
from .test_retrieval import made  # noqa: F401


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "rank", "path", "score").collect()))


@pytest.fixture(scope="module")
def index(spark, made):  # noqa: F811
    _, _, docs, _ = made
    index = TextIndex(spark, f"{shared_folder(spark)}/i")
    index.add(docs.where("path < 'p05'"))
    index.add(docs.where("path >= 'p05'"))
    return index


@pytest.mark.parametrize("first", [1, 8])
def test_equals_the_scan(made, index, first, monkeypatch):  # noqa: F811
    monkeypatch.setattr(text_index, "RANGE", 128)
    _, _, docs, queries = made
    assert rows_of(index.search(queries, 8, first)) == rows_of(retrieval.bm25(docs, queries, 8))


def test_merged_segments_are_one(spark, made, index):  # noqa: F811
    _, _, docs, queries = made
    other = TextIndex(spark, index.folder)
    before = len(index.segments())
    other.merge()
    assert before == 2 and len(index.segments()) == 1 and index.segments()[0]["docs"] == docs.count()
    assert rows_of(index.search(queries, 3)) == rows_of(retrieval.bm25(docs, queries, 3))
    other.merge()  # one segment is left as it is
    assert index.manifests.latest() == 3


def test_ranges_below_the_floor_are_not_read(spark, monkeypatch):
    """Of many ranges with a common word, those with the rare one are read, and no others."""
    monkeypatch.setattr(text_index, "RANGE", 8)
    rows = [(f"p{k:04d}", "common words here" + (" rare" if k in (3, 4, 5, 6) else "")) for k in range(2000)]
    docs = spark.createDataFrame(rows, "path string, body string").coalesce(1)
    index, read = TextIndex(spark, f"{shared_folder(spark)}/i"), []
    index.add(docs)
    scored = TextIndex._scored
    monkeypatch.setattr(TextIndex, "_scored", lambda self, *a: (read.append(a[3].count()), scored(self, *a))[1])
    queries = spark.createDataFrame([(1, "common rare")], "qid long, query string")
    got = rows_of(index.search(queries, 3, first=2))
    assert got == rows_of(retrieval.bm25(docs, queries, 3)) and [g[2] for g in got] == ["p0003", "p0004", "p0005"]
    assert read == [2, 0]


def test_only_wanted_buckets_and_columns_are_read(index):
    plan = plan_of(index.blocks(index.segments(), [3]).select("term", "most"))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "ReadSchema: struct<term:string,most:int>" in plan


def test_empty(spark):
    index = TextIndex(spark, f"{shared_folder(spark)}/i")
    queries = spark.createDataFrame([(1, "word")], "qid long, query string")
    assert index.search(queries, 3).collect() == []
    index.add(spark.createDataFrame([], "path string, body string"))
    assert index.search(queries, 3).collect() == []
    index.add(spark.createDataFrame([("a", None), ("b", "")], "path string, body string"))
    assert index.search(queries, 3).collect() == []


def test_versions_are_put_in_place_once(spark):
    versions = Manifests(spark, f"{shared_folder(spark)}/m")
    assert versions.latest() == 0
    versions.commit(1, {"a": "é"})
    with pytest.raises(Conflict):
        versions.commit(1, {"a": "other"})
    versions.commit(2, {"a": 2})
    assert versions.latest() == 2 and versions.read(1) == {"a": "é"} and versions.read(2) == {"a": 2}


def test_segments_of_two_writers_both_stay(spark, made, monkeypatch):  # noqa: F811
    _, _, docs, queries = made
    index = TextIndex(spark, f"{shared_folder(spark)}/i")
    late = index._segment(docs.where("path >= 'p05'").select("path", text_index.text.terms(text_index.F.coalesce("body", text_index.F.lit(""))).alias("bag")))
    latest = Manifests.latest
    seen = []

    def first_sees_nothing(self):  # the other writer commits between this one's look and its commit
        if not seen:
            seen.append(1)
            index.add(docs.where("path < 'p05'"))
            return 0
        return latest(self)

    monkeypatch.setattr(Manifests, "latest", first_sees_nothing)
    index._commit(late, replaced=None)
    monkeypatch.undo()
    assert len(index.segments()) == 2
    assert rows_of(index.search(queries, 5)) == rows_of(retrieval.bm25(docs, queries, 5))


def test_blocks_are_made_where_documents_lie():
    """Blocks of a task against plain counts, whole ranges at once and cut ones."""
    import pyarrow as pa

    bags = [["a", "b", "a"], [], None, ["b"], ["c", "a"], ["a"] * 5]
    docs = [0, 1, 2, 3, 4, 9]
    for cut in (1, 4, 100):
        text_index.COUNTED, before = cut, text_index.COUNTED
        batches = [pa.RecordBatch.from_arrays([pa.array(docs[k : k + 2], pa.int64()), pa.array(bags[k : k + 2], pa.list_(pa.string()))], names=["doc", "bag"]) for k in (0, 2, 4)]
        rows = [r for b in text_index._blocks(4)(iter(batches)) for r in b.to_pylist()]
        text_index.COUNTED = before
        got = sorted((r["term"], r["range"] * 4 + d, tf, dl) for r in rows for d, tf, dl in zip(r["docs"], r["tfs"], r["dls"]))
        assert got == sorted((t, d, bag.count(t), len(bag)) for d, bag in zip(docs, bags) for t in set(bag or []))
        assert all((r["n"], r["most"], r["least"]) == (len(r["docs"]), max(r["tfs"]), min(r["dls"])) for r in rows)


def test_texts_are_not_joined_with_labels(spark, sf):
    from mnemospark import views

    a, b = views.memory_texts(spark, sf), views.memory_docs(spark, sf)
    assert "Join" not in plan_of(a) and a.exceptAll(b.select(a.columns)).count() == 0 == b.select(a.columns).exceptAll(a).count()


def test_a_search_makes_no_row_for_each_posting(index, made, monkeypatch):  # noqa: F811
    """Blocks meet by ranges and are scored in the task; no posting becomes a row. Queries in several blocks find the same."""
    _, _, docs, queries = made
    assert "Generate" not in plan_of(index.search(queries, 8)) and "MapInArrow" in plan_of(index.search(queries, 8))
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    assert rows_of(index.search(queries, 8)) == rows_of(retrieval.bm25(docs, queries, 8))


def test_files_of_a_segment_are_sorted_by_term(spark):
    """Each task writes its own blocks, so a segment has no more files of a bucket than tasks, each of them sorted."""
    from pyspark.sql import functions as F

    rows = [(f"p{k}", " ".join(f"w{(k * j) % 97}" for j in range(20))) for k in range(400)]
    index = TextIndex(spark, f"{shared_folder(spark)}/i")
    index.add(spark.createDataFrame(rows[:200], "path string, body string").repartition(3))
    index.add(spark.createDataFrame(rows[200:], "path string, body string").repartition(2))
    index.merge()
    (segment,) = index.segments()
    files = spark.read.parquet(f"{index.folder}/{segment['name']}/postings").select(F.input_file_name().alias("f"), "bucket", "term", "range").collect()
    for name in {r.f for r in files}:
        mine = [(r.term, r.range) for r in files if r.f == name]
        assert mine == sorted(mine) and len({r.bucket for r in files if r.f == name}) == 1
