"""Order inside series: chunks and blocks must not change any result."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelfold.operators import baseline, errors, linear, positions, shape
from panelfold.operators.positions import with_positions


@pytest.fixture(scope="module")
def hourly(spark):
    """One long and two short series, hourly."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(uid, start + datetime.timedelta(hours=i), float((i * 37 + k) % 101))
            for k, (uid, n) in enumerate({"hot": 700, "mid": 60, "tiny": 3}.items())
            for i in range(n)]
    return spark.createDataFrame(
        rows, "unique_id string, ds timestamp_ntz, y double").repartition(5).cache()


def table(frame):
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
    return sorted(map(tuple, frame.select(rounded).collect()), key=repr)


OPERATIONS = {
    "positions": lambda p: with_positions(p, "H"),
    "difference": lambda p: shape.difference_series(p, "H"),
    "dummy": lambda p: shape.dummify_series(p, "H"),
    "tails": lambda p: shape.uid_tails(p, 50, "H"),
    "scale": lambda p: errors.mase_scale(with_positions(p, "H"), 24, "H", 12),
    "trends": lambda p: linear.with_trends(with_positions(p, "H"), "H"),
    "lags": lambda p: linear.lag_features(with_positions(p, "H"), 15, "H").select(
        "unique_id", "ds", F.concat_ws(",", F.transform("lags", lambda v: v.cast("string"))).alias("l")),
    "naive": lambda p: baseline.seasonal_naive(with_positions(p, "H"), 12, 24, 24),
    "sums": lambda p: linear.training_sums(
        linear.with_trends(with_positions(p, "H"), "H"), 12, 24, {"a": 24, "b": 12}, "H"),
}


@pytest.mark.parametrize("name", OPERATIONS)
def test_small_blocks_give_the_same(hourly, name, monkeypatch):
    whole = table(OPERATIONS[name](hourly))
    monkeypatch.setattr(positions, "BLOCK_ROWS", 48)
    assert table(OPERATIONS[name](hourly)) == whole
    assert whole


def test_positions_match_a_plain_window(hourly, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK_ROWS", 10)
    rows = with_positions(hourly, "H").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.unique_id, r.ds)):
        by[r.unique_id] = by.get(r.unique_id, 0) + 1
        assert r.pos == by[r.unique_id]
    assert {(r.unique_id, r.n) for r in rows} == {("hot", 700), ("mid", 60), ("tiny", 3)}


def test_a_hot_series_is_spread_over_tasks(hourly, monkeypatch):
    """No (series, block) group holds more than a block and its edge copies."""
    monkeypatch.setattr(positions, "BLOCK_ROWS", 48)
    near = positions.neighbours(with_positions(hourly, "H"), "H", before=24, after=12)
    assert near.rows.groupBy(*near.keys).count().agg(F.max("count")).first()[0] <= 48 + 24 + 12
    core = near.only_core(near.rows)
    assert core.count() == hourly.count()


@pytest.mark.parametrize("freq", ["D", "H", None])
def test_rows_without_a_time_come_last(spark, freq):
    rows = spark.createDataFrame(
        [("a", None, 9.0), ("a", datetime.datetime(2024, 1, 2), 2.0),
         ("a", datetime.datetime(2024, 1, 1), 1.0)],
        "unique_id string, ds timestamp_ntz, y double")
    got = {r.y: (r.pos, r.n) for r in with_positions(rows, freq).collect()}
    assert got == {1.0: (1, 3), 2.0: (2, 3), 9.0: (3, 3)}
