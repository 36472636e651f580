"""The nested experiment: tune and compare models by inner folds, judge them outside.

All methods, folds, configurations and models of a panel run together:

1. positions and trends of the panel, and the split assignments, written once;
2. one pass over the training windows sums products for all three fits
   (validation, inner, final) of every fold; the coefficients are written;
3. validation losses of all configurations; the best one per fold;
4. inner forecasts of test series; the best configuration over all folds;
5. outer forecasts of every series with the final fit.

Steps read each other's results as small tables, so a plan never repeats the
work, or the planning, of the steps before it.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import inline_rows
from ..operators import configs as C
from ..operators import linear as L
from ..operators.baseline import seasonal_naive
from ..operators.positions import with_positions
from ..operators.shape import sampled_per_seed
from ..operators.splits import ALL_METHODS, Scheme, split_all
from ..schema import (BASELINE, ID, N_SAMPLES, OUT_SERIES_FRACTION, OUT_SET_MULTIPLIER, POS, SEED,
                      TARGET, TIME)
from ..session import materialize
from ..sources.results import pending_tasks, stored_partitions, write_cv_results
from . import tuning as T

FOLD = ["seed", "method", "fold"]
RUN = ["seed", "method"]
FORECAST = ["seed", "method", "stage", "fold", ID, "cutoff", TIME, "lead", "model", "yhat", TARGET]


@dataclass(frozen=True)
class Experiment:
    """Settings of one run on one panel."""

    horizon: int
    season: int
    freq: str
    seeds: tuple[int, ...] = (SEED,)
    n_samples: int = N_SAMPLES
    out_series_fraction: float = OUT_SERIES_FRACTION
    out_multiplier: int = OUT_SET_MULTIPLIER
    methods: dict[str, Scheme] | None = None
    families: tuple[str, ...] = ("NLinear", "DLinear")
    # Pairs (seed, method) to run; None: all.
    only: tuple[tuple[int, str], ...] | None = None

    @property
    def method_names(self) -> list[str]:
        return list(self.methods) if self.methods is not None else list(ALL_METHODS)

    @property
    def tasks(self) -> list[tuple[int, str]]:
        every = [(s, m) for s in self.seeds for m in self.method_names]
        return every if self.only is None else [t for t in every if t in self.only]

    @property
    def windows(self) -> T.Windows:
        return T.Windows(self.horizon, self.season, self.out_multiplier)


def assignments(panel: DataFrame, run: Experiment) -> DataFrame:
    """Splits of the in-set series for every seed and method."""
    kept = sampled_per_seed(panel, 1 - run.out_series_fraction, list(run.seeds))
    rows = split_all(kept, None, run.methods).select(*FOLD, ID, "role")
    if run.only is None:
        return rows
    return rows.filter(F.concat_ws("|", "seed", "method").isin([f"{s}|{m}" for s, m in run.tasks]))


@dataclass(frozen=True)
class Fitted:
    """The shared intermediate results of a run."""

    run: Experiment
    trended: DataFrame
    assigned: DataFrame
    coefs: DataFrame
    scores: DataFrame

    def role(self, role: str) -> DataFrame:
        return self.assigned.filter(F.col("role") == role).select(*FOLD, ID)


# The group of the final fit among the folds.
FINAL = {"seed": -1, "method": "final", "fold": 0}


def prepare(panel: DataFrame, run: Experiment) -> tuple[DataFrame, DataFrame]:
    """Positions with trends, and the split assignments, both written once."""
    trended = materialize(L.with_trends(with_positions(panel, run.freq), run.freq), "panel")
    series = trended.filter(F.col(POS) == 1).select(ID)
    return trended, materialize(assignments(series, run), "assignments")


def fold_coefficients(trended: DataFrame, assigned: DataFrame, run: Experiment) -> DataFrame:
    """Coefficients of every fold before validation and test, and of the final fit.

    The sums per series are written: totals of every seed, what the folds leave out and
    the final fit all read them.
    """
    sums = materialize(T.stage_sums(trended, run.windows, run.freq), "sums")
    folds = L.fit_folds(sums.filter("stage <> 'final'"), assigned, ["seed"], ["method", "fold"])
    keys = ["features", "scaler", "stage", "lead"]
    final = (sums.filter("stage = 'final'").groupBy(*keys).agg(*[F.sum(n).alias(n) for n in L.SUMS])
             .select(*[F.lit(v).alias(k) for k, v in FINAL.items()], *keys, *L.SUMS))
    return folds.unionByName(L.coefficients(final, [*FOLD, *keys]))


def fit_folds(panel: DataFrame, run: Experiment) -> Fitted:
    """Everything up to the losses of the sampled configurations in every fold."""
    trended, assigned = prepare(panel, run)
    coefs = materialize(fold_coefficients(trended, assigned, run), "coefficients")
    train = assigned.filter(F.col("role") == "train")
    losses = T.validation_loss(trended, coefs, train, run.windows, FOLD)
    space = C.config_space(panel.sparkSession, list(run.families))
    scores = T.score_configs(losses, C.sample_configs(space, run.n_samples), FOLD)
    return Fitted(run, trended, assigned, coefs, materialize(scores, "scores"))


def forecast_inner(trended: DataFrame, tested: DataFrame, coefs: DataFrame,
                   run: Experiment) -> DataFrame:
    """Inner forecasts of the test series of every fold, and of the baseline.

    ``coefs`` names the ``model`` of each fold's coefficients. The baseline is
    computed once and joined to the folds.
    """
    out = run.windows.out
    inputs = L.forecast_inputs(trended, run.horizon, run.season, run.horizon, skip_last=out)
    widths = T.stage_widths(trended, run.windows, "inner")
    rows = L.predict(inputs.join(tested, ID), coefs, widths, "inner", FOLD)
    naive = seasonal_naive(trended, run.horizon, run.season, run.horizon, skip_last=out)
    baseline = naive.join(tested, ID).withColumn("model", F.lit(BASELINE))
    keep = [*FOLD, ID, "cutoff", TIME, "lead", "model", "yhat", TARGET]
    return (rows.select(keep).unionByName(baseline.select(keep))
            .withColumn("stage", F.lit("inner")).select(FORECAST))


def forecast_outer(trended: DataFrame, coefs: DataFrame, run: Experiment) -> DataFrame:
    """Outer forecasts of every series, and of the baseline for each run.

    ``coefs`` has the final coefficients per (seed, method, model).
    """
    out = run.windows.out
    inputs = L.forecast_inputs(trended, run.horizon, run.season, out)
    rows = L.predict(inputs, coefs, T.stage_widths(trended, run.windows, "final"), "final", [])
    naive = seasonal_naive(trended, run.horizon, run.season, out)
    runs = inline_rows(run.tasks, RUN)
    baseline = naive.select("*", runs).withColumn("model", F.lit(BASELINE))
    keep = [*RUN, ID, "cutoff", TIME, "lead", "model", "yhat", TARGET]
    return (rows.select(keep).unionByName(baseline.select(keep))
            .withColumn("stage", F.lit("outer")).withColumn("fold", F.lit(0)).select(FORECAST))


def inner_forecasts(fitted: Fitted) -> DataFrame:
    """Forecasts of each fold's test series by its best configuration per model."""
    chosen = C.best_config_single(fitted.scores, FOLD).select(
        *FOLD, "model", "features", "scaler")
    coefs = T.stage_coefs(fitted.coefs, "inner").join(chosen, [*FOLD, "features", "scaler"])
    return forecast_inner(fitted.trended, fitted.role("test"), coefs, fitted.run)


def best_configs(fitted: Fitted) -> DataFrame:
    """The winning configuration per (seed, method, model) over all folds."""
    return C.best_config_across_folds(fitted.scores, RUN)


def final_coefs(coefs: DataFrame) -> DataFrame:
    """Coefficients of the fit on every series, all data but the out-set."""
    return T.stage_coefs(coefs, "final").drop(*FOLD)


def refit_final(fitted: Fitted) -> DataFrame:
    """Outer forecasts by the winners, refitted on every series.

    Methods that chose the same configuration share its coefficients.
    """
    chosen = best_configs(fitted).select(
        *RUN, F.col("family").alias("model"), "features", "scaler")
    per_run = final_coefs(fitted.coefs).join(chosen, ["features", "scaler"])
    return forecast_outer(fitted.trended, per_run, fitted.run)


def nested_cv(panel: DataFrame, run: Experiment) -> DataFrame:
    """Inner and outer forecasts of every seed, method and model in long form."""
    fitted = fit_folds(panel, run)
    return inner_forecasts(fitted).unionByName(refit_final(fitted))


def resume(panel: DataFrame, run: Experiment, dataset: str, path: str) -> int:
    """Run and store what ``path`` doesn't hold in full yet; the number of pairs run.

    A (seed, method) with both stages stored is left alone. The stored ones come from
    the file listing; only those pairs reach the driver.
    """
    spark = panel.sparkSession
    tasks = spark.createDataFrame([(s, dataset, m) for s, m in run.tasks],
                                  "seed int, dataset string, method string")
    left = pending_tasks(tasks, stored_partitions(spark, path)).collect()  # seeds x methods
    if left:
        part = replace(run, only=tuple((r["seed"], r["method"]) for r in left))
        write_cv_results(nested_cv(panel, part).withColumn("dataset", F.lit(dataset)), path)
    return len(left)
