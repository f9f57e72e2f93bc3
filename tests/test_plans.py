"""What the planner makes of some queries: pruned columns, pushed filters, no Python where none is needed."""

import re

import pytest

from mnemospark import plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_asked(spark, sf):
    plan = plan_of(plans.QUERIES["a29_index_state"](spark, sf))
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", plan)[1])) == {"source", "n_chars"}
    plan = plan_of(plans.QUERIES["pf6_payload_filter"](spark, sf))
    assert "EqualTo(source,src3)" in plan and "EqualTo(lang,fr)" in plan


@pytest.mark.parametrize("name", ["a1_activity_series_day", "a6_kpi_summary", "a8_recall_report", "w1_current_election", "f1_word_set", "f17_entropy", "f18_secret_scan", "f19_redaction", "f21_write_path_redaction", "pf19_event_normalize", "w10_cron_timeline"])
def test_no_python_in_declarative_queries(spark, sf, name):
    assert not re.search(r"Python|Pandas|MapInArrow", plan_of(plans.QUERIES[name](spark, sf)))


@pytest.mark.parametrize("name", ["t10_bm25", "t1_dense_top_k"])
def test_retrieval_shuffles_its_best_alone(spark, sf, name):
    """Scores are made in the tasks that read the documents; behind them are at most k rows a query and task."""
    plan = plan_of(plans.QUERIES[name](spark, sf))
    scan = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in scan.split("Scan parquet")[0]


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_no_cartesian_product(spark, sf, name):
    if name.startswith(("st1_engine_stream", "sc13", "st8_claim_stream")):
        pytest.skip("runs a stream")
    assert "CartesianProduct" not in plan_of(plans.QUERIES[name](spark, sf))


def test_aggregations_combine_before_the_shuffle(spark, sf):
    plan = plan_of(plans.QUERIES["a4_harness_summary"](spark, sf))
    assert plan.index("partial_") > 0


def test_election_needs_no_ordered_window(spark, sf):
    plan = plan_of(plans.QUERIES["w1_current_election"](spark, sf))
    assert "min_by" in plan and plan.count("Window") <= 2  # the view's own lag


def test_records_are_numbered_by_ranges(spark, sf):
    plan = plan_of(plans.QUERIES["pf16_category_rules"](spark, sf))
    assert "windowspecdefinition(run_type" not in plan and "windowspecdefinition(__range" in plan
