"""Fits from sums of products against plain least squares over all windows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfold.operators import linear, ridge, splits
from panelfold.operators.positions import with_positions

H, M = 3, 7


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    return {f"s{i}": np.round(10 * i + rng.normal(0, 3, 40 + i).cumsum(), 3) for i in range(9)}


@pytest.fixture(scope="module")
def rows(daily, values):
    frame = with_positions(daily({k: list(v) for k, v in values.items()}), "D")
    return linear.with_trends(frame, "D").cache()


def windows(y, lead, hold, features):
    """(x1, x2, z) of one series by direct indexing; positions are 0-based."""
    out = []
    n = len(y)
    for t in range(n):
        if t + lead >= n - hold:
            continue
        phase = (lead - 1) % M + 1
        back = [t - j * M + phase for j in (1, 2)]
        if back[0] < 0 or (features == "season2" and back[1] < 0):
            continue
        if features == "season1":
            out.append((y[back[0]] - y[t], 0.0, y[t + lead] - y[t]))
        elif features == "season2":
            out.append(((y[back[0]] + y[back[1]]) / 2 - y[t], 0.0, y[t + lead] - y[t]))
        else:
            w = int(features.removeprefix("trend"))
            if t + 1 < w:
                continue
            trend = y[t - w + 1:t + 1].mean()
            out.append((y[t] - trend, y[back[0]] - trend, y[t + lead] - trend))
    return np.array(out).reshape(-1, 3)


@pytest.mark.parametrize("features,scaler", [
    ("season1", "none"), ("season2", "standard"), ("trend11", "none"), ("trend25", "standard")])
def test_coefficients_are_least_squares(rows, values, features, scaler):
    stages = {"s": 5}
    sums = linear.apply_scalers(
        linear.training_sums(rows, H, M, stages, "D", (features,)),
        linear.series_widths(rows, stages), stages, (scaler,))
    assigned = splits.kfold(rows, 3)
    train = assigned.filter("role = 'train'")
    members = defaultdict(list)
    for r in train.collect():
        members[r.fold].append(r.unique_id)
    found = linear.fit(sums, train, ["fold"]).collect()
    assert len(found) == 3 * H
    for r in found:
        parts = []
        for uid in members[r.fold]:
            y = values[uid]
            width = 1.0 if scaler == "none" else y[:len(y) - 5].std()
            parts.append(windows(y, r.lead, 5, features) / width)
        data = np.concatenate(parts)
        x = np.column_stack([data[:, 0], np.ones(len(data))])
        if features.startswith("trend"):
            x = np.column_stack([data[:, 0], data[:, 1], np.ones(len(data))])
        beta = np.linalg.lstsq(x, data[:, 2], rcond=None)[0]
        assert r.n_windows == len(data)
        assert r.b1 == pytest.approx(beta[0], rel=1e-6)
        assert r.a == pytest.approx(beta[-1], rel=1e-6, abs=1e-9)
        if features.startswith("trend"):
            assert r.b2 == pytest.approx(beta[1], rel=1e-6)


def test_weights_repeat_series(rows):
    stages = {"s": 5}
    sums = linear.apply_scalers(
        linear.training_sums(rows, H, M, stages, "D", ("season1",)),
        linear.series_widths(rows, stages), stages, ("none",))
    drawn = splits.bootstrap(rows, weights=True).filter("weight > 0").cache()
    repeated = drawn.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    by_weight = linear.fit(sums, drawn, ["fold"], "weight").orderBy("lead").collect()
    by_copies = linear.fit(sums, repeated, ["fold"]).orderBy("lead").collect()
    assert [r.n_windows for r in by_weight] == [r.n_windows for r in by_copies]
    assert [r.b1 for r in by_weight] == pytest.approx([r.b1 for r in by_copies])


def test_no_fit_sees_the_held_out_rows(daily, values):
    """Changing the test window must change no coefficient."""
    def coefs(series):
        frame = linear.with_trends(with_positions(daily(series), "D"), "D")
        stages = {"s": H}
        sums = linear.apply_scalers(linear.training_sums(frame, H, M, stages, "D"),
                                    linear.series_widths(frame, stages), stages)
        everyone = frame.select("unique_id").distinct().withColumn("g", F.lit(0))
        return sorted(map(tuple, linear.fit(sums, everyone, ["g"]).collect()))
    changed = {k: list(v[:-H]) + [1e6] * H for k, v in values.items()}
    assert coefs({k: list(v) for k, v in values.items()}) == coefs(changed)


def test_test_series_do_not_train(rows):
    assigned = splits.holdout(rows)
    out = linear.global_fit_predict(rows, assigned, H, M, "D")
    tested = {r.unique_id for r in assigned.filter("role = 'test'").collect()}
    assert {r.unique_id for r in out.collect()} == tested


def test_few_windows_left_by_a_fold_are_no_rounding(spark):
    """Only series a has a window among those that train: no variation, no coefficient."""
    def sums(uid, x, z):
        return (uid, "season1", "none", "val", 1, 1.0, x, 0.0, z, x * x, 0.0, 0.0, x * z, 0.0)

    table = spark.createDataFrame(
        [sums("a", 0.1, 0.7), sums("c", 1e5 / 3, 2e4 / 7)], "unique_id string, features string, scaler string,"
        " stage string, lead int, " + ", ".join(f"{n} double" for n in linear.SUMS))
    assigned = spark.createDataFrame(
        [(7, "m", 0, uid, "test" if uid == "c" else "train") for uid in "abc"],
        "seed int, method string, fold int, unique_id string, role string")
    found = linear.fit_folds(table, assigned, ["seed"], ["method", "fold"]).collect()
    direct = linear.fit(table, assigned.filter("role = 'train'"), ["seed", "method", "fold"]).collect()
    assert [(r.n_windows, r.b1, r.a) for r in found] == [(r.n_windows, r.b1, r.a) for r in direct] == [(1, None, None)]


def test_ridge_is_penalized_least_squares(rows, values):
    lags, penalty = 5, 2.0
    assigned = splits.holdout(rows)
    betas = ridge.ridge_coefficients(
        rows, assigned.filter("role = 'train'"), H, lags, penalty, H, "D").collect()
    train = [r.unique_id for r in assigned.filter("role = 'train'").collect()]
    assert len(betas) == H
    for r in betas:
        x, z = [], []
        for uid in train:
            y = values[uid]
            for t in range(lags - 1, len(y)):
                if t + r.lead < len(y) - H:
                    x.append([*(y[t - lags + 1:t] - y[t]), 1.0])
                    z.append(y[t + r.lead] - y[t])
        x, z = np.array(x), np.array(z)
        shrink = penalty * np.eye(lags)
        shrink[-1, -1] = 0
        expected = np.linalg.solve(x.T @ x + shrink, x.T @ z)
        assert r.beta == pytest.approx(expected, rel=1e-6, abs=1e-9)
    out = ridge.ridge_lags_forecast(rows, assigned, H, lags, penalty, "D").collect()
    beta = {r.lead: np.array(r.beta) for r in betas}
    for r in out:
        y = values[r.unique_id]
        c = len(y) - H - 1
        steps = np.array([*(y[c - lags + 1:c] - y[c]), 1.0])
        assert r.yhat == pytest.approx(y[c] + steps @ beta[r.lead], rel=1e-6)
