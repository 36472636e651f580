"""The nested experiment end to end on a small panel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfold.operators import splits
from panelfold.plans import nested_cv as N
from panelfold.plans import scoring, variants
from panelfold.operators import reports
from panelfold.operators.positions import with_positions
from panelfold.sources import results as R

H, M, LENGTH, SERIES = 3, 7, 45, 20
METHODS = {"KFold": splits.Folds(4), "Bootstrap": splits.Bootstrap(),
           "TimeHoldout": splits.EverySeries()}
RUN = N.Experiment(H, M, "D", (1, 2), n_samples=6, methods=METHODS)


@pytest.fixture(scope="module")
def panel(daily):
    rng = np.random.default_rng(3)
    season = 5 * np.sin(2 * np.pi * np.arange(LENGTH) / M)
    return daily({f"s{i}": [round(float(v), 3) for v in
                            20 + i + season + rng.normal(0, 1, LENGTH).cumsum()]
                  for i in range(SERIES)})


@pytest.fixture(scope="module")
def fitted(panel):
    return N.fit_folds(panel, RUN)


@pytest.fixture(scope="module")
def forecasts(fitted):
    return N.inner_forecasts(fitted).unionByName(N.refit_final(fitted)).cache()


def test_inner_scores_test_series_on_the_inner_window(fitted, forecasts, panel):
    last = panel.agg(F.max("ds")).first()[0]
    inner = forecasts.filter("stage = 'inner'").collect()
    tested = {(r.seed, r.method, r.fold, r.unique_id) for r in fitted.role("test").collect()}
    assert {(r.seed, r.method, r.fold, r.unique_id) for r in inner} == tested
    # The out-set is the last 2h days; the inner test window is the h days before.
    assert {(last - r.ds).days for r in inner} == set(range(2 * H, 3 * H))
    assert {(last - r.cutoff).days for r in inner} == {3 * H}


def test_outer_covers_every_series_and_origin(forecasts):
    outer = forecasts.filter("stage = 'outer'")
    sizes = outer.groupBy("seed", "method", "model").agg(
        F.countDistinct("unique_id").alias("u"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sizes) == 2 * 3 * 3
    assert {(r.u, r.n) for r in sizes} == {(SERIES, SERIES * (H + 1) * H)}


def test_in_set_is_a_sample_of_series(fitted):
    used = fitted.assigned.groupBy("seed").agg(F.countDistinct("unique_id").alias("n")).collect()
    assert {r.n for r in used} == {14}


def test_out_set_never_reaches_a_fit(panel, fitted):
    """Changing the out-set changes no coefficient, loss or choice."""
    last = panel.agg(F.max("ds")).first()[0]
    changed = panel.withColumn("y", F.when(
        F.datediff(F.lit(last), "ds") < 2 * H, F.lit(1e6)).otherwise(F.col("y")))
    again = N.fit_folds(changed, RUN)
    keys = ["seed", "method", "fold", "features", "scaler", "stage", "lead"]

    def rows(run):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                for r in run.coefs.select(*keys, "a", "b1", "b2").orderBy(*keys).collect()]
    assert rows(fitted) == rows(again)


def test_selected_configuration_has_the_least_loss(fitted):
    best = {(r.seed, r.method, r.model): r.loss for r in N.best_configs(fitted).collect()}
    means = fitted.scores.groupBy("seed", "method", "model", "hash_value").agg(
        F.avg("loss").alias("l")).groupBy("seed", "method", "model").agg(F.min("l").alias("l"))
    for r in means.collect():
        assert best[(r.seed, r.method, r.model)] == pytest.approx(r.l, rel=1e-6)


def test_models_beat_the_baseline_on_seasonal_walks(forecasts):
    errors = forecasts.filter("stage = 'outer'").groupBy("model").agg(
        F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("e")).collect()
    found = {r.model: r.e for r in errors}
    assert found["NLinear"] < found["SeasonalNaive"]
    assert found["DLinear"] < found["SeasonalNaive"]


def test_store_score_and_resume(spark, panel, forecasts, tmp_path):
    path = str(tmp_path / "results")
    R.write_cv_results(forecasts.withColumn("dataset", F.lit("small")), path)
    stored = R.read_cv_results(spark, path)
    rows = stored.withColumn("model", R.strip_model_prefix(F.col("model")))
    scales = scoring.scale_tables(with_positions(panel, "D"), "small", M, H, "D")
    scores = reports.estimation_scores(scoring.model_errors(rows, scales), scoring.RUN).collect()
    assert len(scores) == 2 * 3
    assert all(r.MAPEE >= abs(r.MPEE) - 1e-12 and r.Regret >= 0 for r in scores)
    tasks = stored.select("seed", "dataset", "method").distinct()
    assert R.pending_tasks(tasks, stored).count() == 0


def test_variants_choose_and_refit(panel):
    done = variants.run_variants(panel, RUN, F.lit(4))
    best = variants.best_variants(done.inner).collect()
    assert len(best) == 2 * 3 * 2
    assert all(r.model.startswith(f"{r.family}_") for r in best)
    outer = variants.outer_variants(done).filter("model <> 'SeasonalNaive'")
    chosen = {(r.seed, r.method, r.model) for r in best}
    assert {(r.seed, r.method, r.model) for r in outer.select(
        "seed", "method", "model").distinct().collect()} == chosen
