"""Missing values in rankings, time zones, wide draws, equal times, resuming."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from panelfold.functions.exprs import hash_number, hash_text
from panelfold.operators import reports as R
from panelfold.operators.positions import with_positions
from panelfold.plans import nested_cv as N
from panelfold.sources import results as S
from panelfold.operators.shape import resample_daily
from panelfold.sources.panels import panel_params, parse_timestamps, read_panel
from workload.panels import panel
from workload.stored import experiment


def test_missing_errors_have_no_rank(spark):
    rows = [("d1", "A", 1.0), ("d1", "B", None), ("d1", "C", 2.0), ("d2", "A", 3.0), ("d2", "B", 1.0), ("d2", "C", None)]
    down = spark.createDataFrame(rows, "dataset string, method string, selected_error double")
    board = {(r["dataset"], r["method"]): r["value"] for r in R.method_leaderboard(down).collect()}
    assert [board["Avg. Rank", m] for m in "ABC"] == [1.5, 1.0, 2.0]
    assert [board["Top 2 Count", m] for m in "ABC"] == [2.0, 1.0, 1.0]
    marks = {(r["dataset"], r["method"]): r["mark"] for r in R.annotate_top2(R.method_leaderboard(down)).collect()}
    assert marks["d1", "A"] == "best" and marks["d1", "B"] is None and marks["d1", "C"] == "second"
    outer = down.select("dataset", F.lit("m").alias("model"), "method", F.col("selected_error").alias("outer"))
    assert {r["method"]: r["avg_rank"] for r in R.rank_methods(outer).collect()} == {"A": 1.5, "B": 1.0, "C": 2.0}
    swapped = down.select("dataset", F.lit("m").alias("method"), F.col("method").alias("model"),
                          F.col("selected_error").alias("outer"))
    assert {r["model"]: r["avg_rank"] for r in R.rank_models(swapped).collect()} == {"A": 1.5, "B": 1.0, "C": 2.0}
    names = ["outer_error", "inner_error", "estimation_error", "abs_estimation_error"]
    models = down.select("dataset", F.lit("x").alias("method"), F.col("method").alias("model"),
                         *[F.when(F.col("method") != "B", F.col("selected_error")).alias(n) for n in names])
    ranks = {r["model"]: (r["outer_rank"], r["difficulty_rank"]) for r in R.summarize_models(models).collect()}
    assert ranks == {"A": (1, 1), "B": (None, None), "C": (1, 1)}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("a", "2024-03-10 02:30:00"), ("a", "2024-11-03 01:30:00"), ("b", "2024-03-10 02:30:00"), ("b", "bad"),
                (None, "2024-03-10 02:30:00")]
        frame = spark.createDataFrame(rows, "dataset string, ds string")
        found = parse_timestamps(frame, "ds", "dataset").select("dataset", F.col("ds").cast("string").alias("t")).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, [
            ("a", "2024-03-10 02:30:00"), ("a", "2024-11-03 01:30:00"), ("b", "2024-03-10 00:00:00"), ("b", None),
            (None, "2024-03-10 02:30:00")]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_draws_use_sixty_bits(spark):
    top = spark.range(2000).agg(F.max(hash_number(hash_text(F.col("id"))))).first()[0]
    assert 2 ** 59 < top < 2 ** 60


@pytest.mark.parametrize("freq", [None, "D", "H"])
def test_positions_of_equal_and_missing_times_are_stable(spark, freq):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a", day, float(i % 50)) for i in range(300)] + [("a", None, float(i)) for i in range(100)]
    frame = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    one = with_positions(frame, freq).select("pos", "ds", "y").collect()
    two = with_positions(frame.repartition(7, "y"), freq).select("pos", "ds", "y").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert sorted(r["pos"] for r in one) == list(range(1, 401))
    assert all(r["pos"] > 300 for r in one if r["ds"] is None)


def test_a_second_run_writes_nothing(spark, tmp_path):
    sf, path = "/root/testdata/sf0.001", str(tmp_path / "results")
    run = experiment("nation_month", seeds=(1,))
    run = N.replace(run, only=((1, "KFold"), (1, "Holdout")))
    rows = panel(spark, sf, "nation_month")
    assert S.stored_partitions(spark, path).count() == 0
    assert N.resume(rows, run, "n+m %x", path) == 2

    def files():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}
    first = files()
    assert N.resume(rows, run, "n+m %x", path) == 0
    assert files() == first
    found = {tuple(r) for r in S.stored_partitions(spark, path).collect()}
    assert found == {(1, "n+m %x", m, s) for m in ("KFold", "Holdout") for s in ("inner", "outer")}
    more = N.replace(run, only=((1, "KFold"), (1, "MonteCarlo")))
    assert N.resume(rows, more, "n+m %x", path) == 1
    # New are the files of the new method, and the record of them; all others stay as they were.
    assert {f: t for f, t in files().items() if f in first and "_SUCCESS" not in f} == {
        f: t for f, t in first.items() if "_SUCCESS" not in f}
    assert all("MonteCarlo" in f or "_commits" in f for f in files().keys() - first.keys())
    plan = S.complete_pairs(S.stored_partitions(spark, path))._jdf.queryExecution().toString()
    assert "binaryFile" in plan and "yhat" not in plan


def test_resampled_reading(spark, tmp_path):
    hours = [("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=6 * i), float(i)) for i in range(12)]
    for group in ("Exchange", "TrafficL", "ETTm1"):
        spark.createDataFrame(hours, "unique_id string, ds timestamp_ntz, y double").write.parquet(f"{tmp_path}/{group}")

    def read(group, to):
        return read_panel(spark, str(tmp_path), group, resample_to=to)
    assert read("Exchange", "D").count() == read("TrafficL", "H").count() == 12
    assert [r["y"] for r in read("TrafficL", "D").orderBy("ds").collect()] == [1.5, 5.5, 9.5]
    assert read("ETTm1", "H").count() == 67
    params = {(g, t): tuple(panel_params(spark, g, t).first()) for g in ("ECL", "ETTm1") for t in (None, "D", "H")}
    assert params["ECL", "H"] == params["ECL", None] == ("ECL", "H", 96, 120, 24)
    assert params["ETTm1", "D"] == ("ETTm1", "D", 14, 17, 365) and params["ETTm1", "H"] == ("ETTm1", "H", 48, 60, 24)
    for group, to in (("ETTm1", "W"), ("monash_hospital", "D")):
        with pytest.raises(ValueError):
            read(group, to)


def test_gaps_of_centuries(spark):
    rows = [("a", datetime.datetime(1700, 6, 1, 5), 1.0), ("a", datetime.datetime(1950, 1, 1), 2.0)]
    daily = resample_daily(spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double"))
    days = (datetime.date(1950, 1, 1) - datetime.date(1700, 6, 1)).days + 1
    assert daily.count() == daily.select("ds").distinct().count() == days
    assert daily.filter("y is not null").count() == 2
