"""Fixed variants instead of tuned models: every configuration is a forecast column.

Variants are rows of a table, so all of them and all folds run in one job. The
best variant of each family is chosen on the inner forecasts themselves, then
refitted for the outer ones.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import configs as C
from ..schema import BASELINE, ID
from ..session import materialize
from . import tuning as T
from .nested_cv import (FOLD, RUN, Experiment, final_coefs, fold_coefficients, forecast_inner,
                        forecast_outer, prepare)


@dataclass(frozen=True)
class VariantRun:
    """Shared intermediate results: variants, coefficients and inner forecasts."""

    run: Experiment
    trended: DataFrame
    coefs: DataFrame
    variants: DataFrame
    inner: DataFrame


def run_variants(panel: DataFrame, run: Experiment, input_size: Column) -> VariantRun:
    """Inner forecasts of every fold's test series by every variant."""
    trended, assigned = prepare(panel, run)
    coefs = materialize(fold_coefficients(trended, assigned, run), "coefficients")
    space = C.config_space(panel.sparkSession, list(run.families))
    drawn = C.effective_model(C.sample_configs(space, run.n_samples))
    variants = C.expand_variants(drawn, F.lit(run.horizon), input_size).select(
        F.col("variant").alias("model"), "family", "features", "scaler", "config")
    tested = assigned.filter(F.col("role") == "test").select(*FOLD, ID)
    named = T.stage_coefs(coefs, "inner").join(
        variants.select("model", "features", "scaler"), ["features", "scaler"])
    inner = forecast_inner(trended, tested, named, run)
    return VariantRun(run, trended, coefs, variants, inner)


def best_variants(inner: DataFrame) -> DataFrame:
    """Per (seed, method) and family, the variant with the least inner error.

    The error is taken per fold appearance of a series, as the inner frame
    counts each appearance as a series of its own.
    """
    named = inner.filter(F.col("model") != BASELINE).withColumn(
        ID, F.concat(F.col(ID), F.lit("_fold"), F.col("fold").cast("string")))
    return C.best_variant_per_family(named, RUN)


def outer_variants(done: VariantRun) -> DataFrame:
    """Outer forecasts by the winning variants, under their variant names."""
    winners = best_variants(done.inner).select(*RUN, "model").join(
        done.variants.select("model", "features", "scaler"), "model")
    per_run = final_coefs(done.coefs).join(winners, ["features", "scaler"])
    return forecast_outer(done.trended, per_run, done.run)
