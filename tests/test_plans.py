"""What the physical plans must and must not contain."""

import os

import pytest

from panelfold.operators import linear, shape, splits
from panelfold.operators.positions import with_positions
from panelfold.sources.results import only_complete
from tests.compare import DATA
from workload import registered
from workload.panels import panel

QUERIES, _ = registered()
SF = os.path.join(DATA, "sf0.001")

def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def single_tasks(text):
    """Inputs of the exchanges that gather everything in one task."""
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


@pytest.mark.parametrize("key", [
    "cv_outer", "seasonal_naive", "mase_scale", "cv_registry", "resample_daily", "sample_uids",
    "nested_time_split", "validate_frequency", "load_panel", "mae_by_series", "lag_features"])
def test_no_python_and_no_single_task(spark, key):
    text = plan(QUERIES[key](spark, SF))
    assert "Python" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if key != "load_panel":  # the first n series are a top-n
        assert all("_bucket" in child for child in single_tasks(text))


def test_scan_reads_needed_columns_only(spark):
    text = plan(QUERIES["time_wise_split"](spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in text


def test_one_shuffle_orders_a_bounded_panel(spark):
    """Positions, splits and trends of a daily panel share one shuffle by series."""
    rows = panel(spark, SF, "user_day")
    base = plan(rows).count("Exchange hashpartitioning")
    trended = linear.with_trends(with_positions(rows, "D"), "D")
    assert plan(trended).count("Exchange hashpartitioning") == base
    labelled = shape.nested_time_split(rows, 3, "D")
    assert plan(labelled).count("Exchange hashpartitioning") == base


def test_rank_never_sorts_all_series(spark):
    text = plan(splits.split_all(panel(spark, SF, "user_day")))
    # Only the table of at most 4096 bucket counts is ever gathered.
    gathered = single_tasks(text)
    assert all("HashAggregate" in child and "_bucket" in child for child in gathered)
    assert "rangepartitioning" not in text


def test_reports_carry_no_listing(spark):
    """Tasks return the counters of all nodes below an aggregation: the listing is not among them."""
    text = plan(QUERIES["select_model"](spark, SF))
    assert "binaryFile" not in text and "json" not in text


@pytest.mark.parametrize("name", [
    "average_over_seeds", "estimation_by_model", "round_report", "pivot_model_method", "summarize_models",
    "estimation_scores", "downstream_error", "rank_models", "serieswise_scores", "label_names", "collapse_composite_ids"])
def test_no_report_carries_the_listing(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "binaryFile" not in text and "json" not in text


def test_results_do_not_travel_by_the_keys_of_their_pairs(spark):
    many = spark.range(10 ** 9)
    results = many.selectExpr("cast(id % 2 as int) as seed", "'d' as dataset", "concat('m', id % 7) as method",
                              "if(id % 3 = 0, 'inner', 'outer') as stage", "id as yhat")
    text = plan(only_complete(results))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_inputs_do_not_travel_by_feature_and_lead(spark):
    many = spark.range(10 ** 9)
    inputs = many.selectExpr("cast(id as string) as unique_id", "concat('season', id % 2) as features",
                             "cast(id % 3 as int) as lead", "1D as x1", "0D as x2", "2D as base")
    coefs = many.selectExpr("concat('season', id % 2) as features", "cast(id % 3 as int) as lead",
                            "'none' as scaler", "1D as a", "1D as b1", "0D as b2").distinct()
    widths = many.selectExpr("cast(id as string) as unique_id", "1D as width_final")
    text = plan(linear.predict(inputs, coefs, widths, "final", []))
    by_lead = [line for line in text.splitlines() if "Join" in line and "lead#" in line]
    assert len(by_lead) == 1 and "BroadcastHashJoin" in by_lead[0]
