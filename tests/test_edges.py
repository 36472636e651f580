"""Hand-made edge cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelfold.operators import baseline, configs, errors, linear, origins, reports, shape
from panelfold.operators.positions import with_positions
from panelfold.plans import tuning
from panelfold.sources import panels, params
from panelfold.sources import results as stored


def test_short_series_is_all_test(daily):
    parts = shape.label_time_split(daily({"a": [1, 2]}), 5, "D").collect()
    assert [r.part for r in parts] == ["test", "test"]
    train, test = shape.time_wise_split(daily({"a": [1, 2], "b": range(9)}), 5, "D")
    assert train.count() == 4 and test.count() == 7


def test_nested_parts_sizes(daily):
    rows = shape.nested_time_split(daily({"a": range(20)}), 3, "D")
    assert {r.part: r["count"] for r in rows.groupBy("part").count().collect()} == {
        "out": 6, "in": 3, "dev": 11}


def test_constant_series_has_no_scale(daily):
    rows = with_positions(daily({"c": [3] * 10, "v": range(10)}), "D")
    scales = {r.unique_id: r.scale for r in errors.mase_scale(rows, 2, "D").collect()}
    assert scales == {"c": None, "v": 2.0}


def test_series_shorter_than_season(daily):
    rows = with_positions(daily({"s": range(5)}), "D")
    assert errors.mase_scale(rows, 12, "D").first().scale is None
    assert {r.yhat for r in baseline.seasonal_naive(rows, 2, 12, 2).collect()} == {None}


def test_horizon_longer_than_season(daily):
    rows = with_positions(daily({"s": range(1, 21)}), "D")
    got = {r.lead: r.yhat for r in baseline.seasonal_naive(rows, 6, 4, 6).collect()}
    assert got == {1: 11, 2: 12, 3: 13, 4: 14, 5: 11, 6: 12}


def test_gap_is_filled_with_null(spark):
    day = datetime.datetime(2024, 1, 1, 5)
    raw = spark.createDataFrame(
        [("a", day, 1.0), ("a", day, 3.0), ("a", day + datetime.timedelta(days=2), 5.0)],
        "unique_id string, ds timestamp_ntz, y double")
    got = [(r.ds.day, r.y) for r in shape.resample_daily(raw).orderBy("ds").collect()]
    assert got == [(1, 2.0), (2, None), (3, 5.0)]
    hours = shape.resample_hourly(raw)
    assert hours.count() == 49 and hours.filter("y is not null").count() == 2


def test_nan_counts_as_missing(spark):
    raw = spark.createDataFrame(
        [("a", 1, float("nan")), ("a", 2, 4.0)], "u string, t int, v double")
    assert panels.load_panel(raw, "u", "t", "v").agg(F.avg("y")).first()[0] == 4.0


def test_sample_rounds_half_even(spark):
    for n, expected in {15: 10, 5: 4, 25: 18, 45: 31}.items():
        frame = spark.range(n).select(F.col("id").cast("string").alias("unique_id"))
        assert shape.sample_uids(frame, 0.7).count() == expected


def test_sampling_honours_the_id_column(spark):
    frame = spark.range(10).select(F.col("id").cast("string").alias("key"), F.lit(1.0).alias("y"))
    assert shape.sample_uids(frame, 0.5, id_col="key").count() == 5
    assert shape.prune_short_series(frame, 2, id_col="key").count() == 0


def test_validate_frequency_counts_gaps_and_copies(spark):
    day = datetime.date(2024, 1, 30)
    rows = [("ok", day + datetime.timedelta(days=i)) for i in range(4)]
    rows += [("gap", day), ("gap", day + datetime.timedelta(days=2))]
    rows += [("copy", day), ("copy", day), ("copy", day + datetime.timedelta(days=1))]
    frame = spark.createDataFrame(rows, "unique_id string, ds date")
    got = {r.unique_id: r.n_bad_steps for r in shape.validate_frequency(frame, "D").collect()}
    assert got == {"gap": 1, "copy": 1}


@pytest.mark.parametrize("freq,times", [
    ("MS", ["2024-01-01", "2024-02-01", "2024-03-01"]),
    ("M", ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30"]),
    ("Q", ["2024-01-01", "2024-04-01", "2024-07-01"]),
    ("Y", ["2023-01-01", "2024-01-01"]), ("W", ["2024-01-01", "2024-01-08"]),
    ("15T", ["2024-01-01 00:00:00", "2024-01-01 00:15:00"])])
def test_regular_steps_pass(spark, freq, times):
    kind = "timestamp_ntz" if ":" in times[0] else "date"
    frame = spark.createDataFrame([("a", t) for t in times], "unique_id string, t string").select(
        "unique_id", F.col("t").cast(kind).alias("ds"))
    assert shape.validate_frequency(frame, freq).count() == 0


def test_scaling_round_trip(daily):
    rows = with_positions(daily({"a": [1, 5, 2, 8, 3], "flat": [2] * 5}), "D")
    for kind in ("standard", "robust"):
        scaled = shape.scale_series(rows, shape.scale_statistics(rows, kind, 1))
        for r in scaled.withColumn("back", shape.unscale(F.col("scaled"))).collect():
            if r.unique_id == "flat":
                assert r.scaled is None
            else:
                assert r.back == pytest.approx(r.y)


def test_base_id_keeps_lookalikes(spark):
    ids = spark.createDataFrame(
        [("a_b",), ("fold_1",), ("fold_1_fold2_x7",), ("a_b_fold0_x0",)], "id string")
    got = [r[0] for r in ids.select(errors.base_id(F.col("id"))).collect()]
    assert got == ["a_b", "fold_1", "fold_1", "a_b"]


def test_composite_ids_number_pairs_in_order(spark):
    rows = spark.createDataFrame(
        [(1, "a"), (0, "b"), (0, "fold_1"), (0, "b"), (1, "b")], "fold int, unique_id string")
    got = {(r.fold, r.unique_id): r.composite_id for r in origins.composite_ids(rows).collect()}
    assert got == {(0, "b"): "b_fold0_x0", (0, "fold_1"): "fold_1_fold0_x1",
                   (1, "a"): "a_fold1_x2", (1, "b"): "b_fold1_x3"}


def test_grid_shape_and_trimming(daily):
    rows = with_positions(daily({"long": range(30), "short": range(7), "none": range(3)}), "D")
    grid = origins.cv_grid(rows, 3, 6)
    sizes = {r.unique_id: r["count"] for r in grid.groupBy("unique_id").count().collect()}
    # 4 windows of 3 leads; a series of 7 has cutoffs 1..4; of 3 has none.
    assert sizes == {"long": 12, "short": 12}
    with pytest.raises(ValueError):
        origins.cv_grid(rows, 6, 3)


def test_validation_rows(daily):
    rows = linear.with_trends(with_positions(daily({"a": range(30)}), "D"), "D")
    windows = tuning.Windows(3, 7, out_multiplier=0)
    leads = linear.forecast_inputs(rows, 3, 7, 3, skip_last=windows.stages["inner"])
    assert sorted({r.y for r in leads.collect()}) == [24.0, 25.0, 26.0]


def test_ties_go_to_the_first_model(spark):
    rows = spark.createDataFrame(
        [("d", "DLinear", 1.0, 2.0), ("d", "NLinear", 1.0, 2.0)],
        "dataset string, model string, inner double, outer double")
    got = reports.select_model(rows, ["dataset"]).first()
    assert (got.selected, got.best) == ("NLinear", "NLinear")


def test_rank_ties(spark):
    rows = spark.createDataFrame(
        [("d", "a", 1.0), ("d", "b", 1.0), ("d", "c", 2.0)],
        "dataset string, method string, selected_error double")
    board = {(r.dataset, r.method): r.value for r in reports.method_leaderboard(rows).collect()}
    assert [board[("Avg. Rank", m)] for m in "abc"] == [1.5, 1.5, 3.0]
    assert [board[("Top 2 Count", m)] for m in "abc"] == [1.0, 1.0, 0.0]
    marks = {r.method: r.mark for r in reports.annotate_top2(
        rows.withColumnRenamed("selected_error", "value")).collect()}
    assert marks == {"a": "best", "b": "best", "c": "second"}


def test_models_rank_truncates(spark):
    rows = spark.createDataFrame(
        [(m, e, e, 0.1, 0.1) for m, e in [("a", 1.0), ("b", 1.0), ("c", 2.0)]],
        "model string, outer_error double, inner_error double, estimation_error double, "
        "abs_estimation_error double")
    got = {r.model: r.outer_rank for r in reports.summarize_models(rows).collect()}
    assert got == {"a": 1, "b": 1, "c": 3}


def test_no_underestimates(spark):
    rows = spark.createDataFrame(
        [("KFold", 0.1, 0.1, 1, 0.0), ("KFold", 0.3, 0.3, 0, 0.2)],
        "method string, MAPEE double, MPEE double, Accuracy int, Regret double")
    got = reports.summarize_methods(rows).first()
    assert got.method == "K-fold CV" and got.perc_underestimates == 0
    assert got.avg_under_estimate is None and got.avg_over_estimate == 0.2


def test_unparsable_time_cuts_all_to_dates(spark):
    rows = spark.createDataFrame(
        [("x", "2024-01-01T05:06:07"), ("x", "9999-01-01T00:00:00"), ("y", "2024-01-01T05:06:07")],
        "dataset string, ds string")
    got = {(r.dataset, r.ds) for r in panels.parse_timestamps(rows, "ds", "dataset").collect()}
    assert got == {("x", datetime.datetime(2024, 1, 1)), ("x", None),
                   ("y", datetime.datetime(2024, 1, 1, 5, 6, 7))}


def test_nested_panel_explodes_arrays_together(spark):
    day = datetime.datetime(2024, 1, 1)
    nested = spark.createDataFrame(
        [("a", [day, day + datetime.timedelta(days=1)], [1.0, 2.0], "c")],
        "id string, timestamp array<timestamp_ntz>, target array<double>, category string")
    rows = panels.conform_columns(panels.explode_nested(nested))
    assert rows.columns == ["unique_id", "ds", "y"]
    assert sorted((r.ds.day, r.y) for r in rows.collect()) == [(1, 1.0), (2, 2.0)]


def test_dataset_parameters(spark):
    got = {r.dataset: (r.freq, r.horizon, r.n_lags, r.season)
           for r in params.dataset_params(spark).collect()}
    assert len(got) == 17
    assert got["monash_m1_monthly"] == ("M", 6, 7, 12)
    assert got["m4_weekly"] == ("W", 13, 16, 52)
    assert got["m4_yearly"] == ("Y", 3, 3, 1)
    assert got["monash_hospital"] == ("MS", 12, 15, 12)
    long = {r.dataset: (r.freq, r.horizon, r.n_lags, r.season)
            for r in params.long_horizon_params(spark, "D").collect()}
    assert long["Weather"] == ("D", 14, 17, 365) and long["Exchange"] == ("D", 14, 17, 365)
    hourly = {r.dataset: r.horizon for r in params.long_horizon_params(spark, "H").collect()}
    assert hourly["ECL"] == 96 and hourly["ETTm1"] == 48
    with pytest.raises(ValueError):
        params.long_horizon_params(spark, "W")


def test_unknown_dataset(spark, tmp_path):
    with pytest.raises(ValueError):
        panels.read_panel(spark, str(tmp_path), "nothing")


def test_read_panel(spark, daily, tmp_path):
    rows = daily({"7": [1, 2, 3], "8": [1]}).withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "m4_daily"))
    got = panels.read_panel(spark, str(tmp_path), "m4_daily", min_n_instances=2)
    assert got.count() == 3 and dict(got.dtypes)["unique_id"] == "string"


def test_config_draws(spark):
    space = configs.config_space(spark)
    drawn = configs.sample_configs(space, 20).collect()
    assert len(drawn) == 200
    mlp = [r.config for r in drawn if r.family == "MLP"]
    assert {c["num_layers"] for c in mlp} == {"2"}
    assert all(1e-4 <= float(c["learning_rate"]) <= 0.1 for c in mlp)
    assert {c["max_steps"] for c in mlp} <= {"500", "1000"}
    steps = {r.config["max_steps"] for r in drawn if r.family == "NLinear"}
    assert all(float(s) % 100 == 0 and 500 <= float(s) <= 1500 for s in steps)
    assert all(1 <= int(c["random_seed"]) < 20 for c in mlp)


def test_config_hash_is_sorted_json_md5(spark):
    import hashlib
    import json
    config = {"b": "None", "a": "[1, 2]", "learning_rate": "0.001"}
    rows = spark.createDataFrame([(config,)], "config map<string,string>")
    expected = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()
    assert rows.select(configs.config_hash(F.col("config"))).first()[0] == expected


@pytest.mark.parametrize("value", [0.1, 0.00123456, 0.00009, 0.00001, 0.0001, 0.05, 0.012345])
def test_rate_text_matches_numpy(spark, value):
    import numpy as np
    rows = spark.createDataFrame([(repr(value),)], "v string")
    assert rows.select(configs.rate_text(F.col("v"))).first()[0] == str(float(np.round(value, 5)))


def test_trial_without_loss_is_skipped(spark):
    rows = spark.createDataFrame(
        [("MLP", 0, {"a": "1"}, None), ("MLP", 1, {"a": "2"}, 0.5)],
        "family string, config_idx int, config map<string,string>, loss double")
    assert [r.config_idx for r in configs.config_scores(rows).collect()] == [1]


def test_variants(spark):
    rows = spark.createDataFrame(
        [("KAN", 0, {"input_size_multiplier": "2", "scaler_type": "robust", "loss": "None",
                     "h": "None", "max_steps": "500"}),
         ("KAN", 1, {"input_size": "9", "scaler_type": "None", "h": "None"})],
        "family string, config_idx int, config map<string,string>")
    got = {r.variant: r.config for r in
           configs.expand_variants(rows, F.lit(6), F.lit(7)).collect()}
    assert got["KAN_0"] == {"h": "6", "input_size": "7", "scaler_type": "standard",
                            "max_steps": "500"}
    assert got["KAN_1"] == {"h": "6", "input_size": "9", "scaler_type": "None"}


def test_half_finished_pair_is_pending(spark):
    rows = spark.createDataFrame(
        [(1, "d", "A", "inner"), (1, "d", "A", "outer"), (1, "d", "B", "inner")],
        "seed int, dataset string, method string, stage string")
    tasks = rows.select("seed", "dataset", "method").distinct()
    assert [r.method for r in stored.complete_pairs(rows).collect()] == ["A"]
    assert [r.method for r in stored.pending_tasks(tasks, rows).collect()] == ["B"]
    assert stored.only_complete(rows).count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_round_trip(spark, tmp_path, fmt):
    day = datetime.datetime(2024, 1, 1)
    rows = [(123, "d", "KFold", stage, f, "007", day, day, 1, "AutoNLinear", None, 2.0)
            for stage in ("inner", "outer") for f in (0, 1)]
    frame = spark.createDataFrame(
        rows, "seed int, dataset string, method string, stage string, fold int, unique_id string, "
        "cutoff timestamp_ntz, ds timestamp_ntz, lead int, model string, yhat double, y double")
    path = str(tmp_path / "results")
    stored.write_cv_results(frame, path, fmt)
    # Writing one stage again replaces that stage only.
    stored.write_cv_results(frame.filter("stage = 'inner' and fold = 0"), path, fmt)
    back = stored.read_cv_results(spark, path, fmt)
    assert {(r.stage, r.fold) for r in back.collect()} == {
        ("inner", 0), ("outer", 0), ("outer", 1)}
    first = back.first()
    assert first.unique_id == "007" and first.yhat is None and first.seed == 123
    assert [r.label for r in stored.discover_seeds(back).collect()] == ["seed_123"]
    names = back.select(stored.strip_model_prefix(F.col("model"))).distinct().collect()
    assert [r[0] for r in names] == ["NLinear"]


def test_catalog(spark, tmp_path):
    for name in ("a,KFold,inner.csv", "a,KFold,outer.csv", "b.parquet", "README.md"):
        (tmp_path / name).write_text("x")
    got = stored.dataset_catalog(spark, str(tmp_path))
    assert sorted(r.dataset for r in got.collect()) == ["a", "b"]


def test_attach_baseline_left_keeps_unmatched(spark):
    keys = "unique_id string, ds int, cutoff int, yhat double"
    rows = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 2, 0, 1.0)], keys)
    naive = spark.createDataFrame([("a", 1, 9, 5.0)], keys)
    left = origins.attach_baseline(rows, naive, "naive", "left")
    assert sorted((r.ds, r.naive) for r in left.collect()) == [(1, 5.0), (2, None)]
    assert origins.attach_baseline(rows, naive, "naive").count() == 0


def test_timing(spark):
    runs = spark.createDataFrame(
        [(32, 1.0), (32, 3.0), (64, 8.0)], "batch int, seconds double")
    summary = reports.timing_summary(runs, ["batch"])
    assert {r.batch: (r["mean"], r["std"]) for r in summary.collect()} == {
        32: (2.0, 1.0), 64: (8.0, 0.0)}
    ends = reports.timing_extremes(summary, ["batch"]).first()
    assert (ends.fastest_batch, ends.slowest_batch, ends.speedup, ends.perc_saved) == (
        32, 64, 4.0, 75.0)
