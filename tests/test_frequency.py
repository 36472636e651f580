"""Frequencies taken from the times of a panel, and fits by what folds leave out."""

import datetime
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from panelfold.operators import linear, splits
from panelfold.operators.positions import with_positions
from panelfold.sources.frequency import infer_frequency
from panelfold.sources.params import dataset_params, long_horizon_params


def month(k, day=1):
    return datetime.datetime(2000 + k // 12, k % 12 + 1, day)


def month_end(k):
    return month(k + 1) - datetime.timedelta(days=1)


START = datetime.datetime(2024, 1, 31, 5)
TIMES = {
    "MS": [month(k) for k in range(20)],
    "ME": [month_end(k) for k in range(20)],
    "M": [month(k, 15) for k in range(20)],
    "Q": [month(3 * k) for k in range(9)],
    "Y": [month_end(12 * k + 11) for k in range(5)],
    "2Y": [month(24 * k) for k in range(5)],
    "W": [START + datetime.timedelta(days=7 * k) for k in range(30)],
    "D": [START + datetime.timedelta(days=k) for k in range(400)],
    "H": [START + datetime.timedelta(hours=k) for k in range(3000)],
    "15T": [START + datetime.timedelta(minutes=15 * k) for k in range(500)],
    "90S": [START + datetime.timedelta(seconds=90 * k) for k in range(100)],
    None: [START],
}


def test_commonest_step_of_every_dataset(spark):
    rows = []
    for freq, times in TIMES.items():
        name = f"d_{freq}"
        for s in range(3):  # gaps, repeats and a missing time change nothing
            kept = [t for k, t in enumerate(times) if s == 0 or k % 11 != 5 + s]
            rows += [(name, f"s{s}", t, 1.0) for t in [*kept, kept[0], None]]
    panel = spark.createDataFrame(rows, "dataset string, unique_id string, ds timestamp_ntz, y double").repartition(5)
    found = {r["dataset"]: r["freq"] for r in infer_frequency(panel).collect()}
    assert found == {f"d_{freq}": freq for freq in TIMES}
    assert infer_frequency(panel.limit(0)).count() == 0


def test_equally_common_steps_take_the_shorter(spark):
    days = [datetime.date(2024, 1, 10) + datetime.timedelta(days=d) for d in (0, 1, 2, 9, 16)]
    panel = spark.createDataFrame([("a", "s", d) for d in days], "dataset string, unique_id string, ds date")
    assert [r["freq"] for r in infer_frequency(panel).collect()] == ["D"]


def test_parameters_follow_the_frequency_found(spark):
    names = spark.createDataFrame([("m4_hourly", "H"), ("m4_x", "W"), ("other", "W"), ("monash_m1_monthly", "MS"),
                                   ("unknown", "90S"), ("none", None)], "dataset string, freq string")
    found = {r["dataset"]: (r["horizon"], r["n_lags"], r["season"]) for r in dataset_params(spark, names).collect()}
    assert found == {"m4_hourly": (48, 60, 24), "m4_x": (13, 16, 52), "other": (8, 10, 52),
                     "monash_m1_monthly": (6, 7, 12), "unknown": (None, None, None), "none": (None, None, None)}
    assert long_horizon_params(spark).count() == 6


@pytest.fixture(scope="module")
def series(daily):
    rng = np.random.default_rng(9)
    values = {f"s{i}": list(np.round(rng.normal(0, 3, 60).cumsum(), 3)) for i in range(12)}
    values |= {f"c{i}": [5.0] * 60 for i in range(6)}
    return linear.with_trends(with_positions(daily(values), "D"), "D").cache()


def test_folds_by_subtraction_equal_folds_by_membership(spark, series):
    ids = series.filter("pos = 1").select("unique_id")
    parts = {"k": splits.kfold(ids, 4), "h": splits.holdout(ids), "b": splits.bootstrap(ids),
             "all": ids.select("unique_id", F.lit(0).alias("fold"),
                               F.explode(F.array(F.lit("train"), F.lit("test"))).alias("role"))}
    keep = ["method", "fold", "unique_id", "role"]
    assigned = reduce(DataFrame.unionByName, [
        part.withColumn("method", F.lit(name)).select(*keep).distinct() for name, part in parts.items()])
    # Only constant series train in this fold: what subtraction leaves must count as no variation.
    lone = ids.select(F.lit("lone").alias("method"), F.lit(0).alias("fold"), "unique_id",
                      F.when(F.col("unique_id").startswith("c"), "train").otherwise("test").alias("role"))
    assigned = assigned.unionByName(lone).withColumn("seed", F.lit(1)).cache()
    stages = {"val": 15, "inner": 9}
    sums = linear.apply_scalers(linear.training_sums(series, 3, 7, stages, "D"),
                                linear.series_widths(series, stages), stages).cache()
    groups = ["seed", "method", "fold"]
    keys = [*groups, "features", "scaler", "stage", "lead"]

    def table(frame):
        return {tuple(r[k] for k in keys): (r["n_windows"], r["b1"], r["b2"], r["a"]) for r in frame.collect()}

    expected = table(linear.fit(sums, assigned.filter("role = 'train'").select(*groups, "unique_id"), groups))
    found = table(linear.fit_folds(sums, assigned, ["seed"], ["method", "fold"]))
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        for x, y in zip(values, found[key]):
            assert (x is None) == (y is None), key
            assert x is None or x == pytest.approx(y, rel=1e-8, abs=1e-8), key


def test_a_window_is_summed_once(spark, series):
    """Windows are not multiplied by feature sets, and the folds join no training series."""
    sums = linear.training_sums(series, 3, 7, {"val": 15, "inner": 9}, "D")
    text = sums._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("slice"):]
    assert below.count("inline(array(named_struct(features") <= 1
    assert "Generate inline" not in text.split("Aggregate")[-1]
