"""Every query of the main library runs on the smallest tables, and equals its SQL where it has one."""

import pytest

import __spark_entry__
from mnemospark import plans

from .oracle import connect


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, db, name):
    from .oracle import same

    df = plans.QUERIES[name](spark, sf)
    if name in plans.ORACLES:
        same(df, db, plans.ORACLES[name])
    else:
        assert df.columns and df.collect()


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "path", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", ["a1_activity_series_day", "t10_bm25", "w1_current_election", "j4_clusters", "w7_rrf_pinned", "a13_bursts"])
def test_partitions_and_order_play_no_part(spark, sf, name, monkeypatch):
    from mnemospark import views

    want = sorted(map(repr, plans.QUERIES[name](spark, sf).collect()))
    read = views.table
    monkeypatch.setattr(views, "table", lambda *a: read(*a).orderBy(__import__("pyspark").sql.functions.rand(3)).repartition(5))
    assert sorted(map(repr, plans.QUERIES[name](spark, sf).collect())) == want


def test_without_the_optional_subpackage():
    """The entry module imports, and lists its queries, where the llm folder is gone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['mnemospark.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 150 and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.__file__.rsplit("/", 1)[0]).returncode == 0
