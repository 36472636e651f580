"""Estimation scores, selections, leaderboards and their display forms.

Inputs here have one row per (seed, dataset, method, model), a size set by the
experiment and not by the data; only the series-wise report is larger, and it
aggregates before anything else.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import average_rank, rank_known
from ..schema import ID
from .errors import first_by

# Order of the models, which settles ties.
MODEL_ORDER = ["KAN", "PatchTST", "NBEATS", "TFT", "TiDE", "NLinear", "MLP", "DLinear", "NHITS",
               "DeepNPTS"]

# Display names.
METHOD_NAMES = {
    "RepeatedBootstrap": "K-Bootstrap",
    "RepeatedHoldout": "K-Holdout",
    "MonteCarlo": "K-MC-CV",
    "KFold": "K-fold CV",
    "TimeHoldout": "Time-Holdout",
}
DATASET_NAMES = {
    "monash_hospital": "Hospital",
    "monash_m1_monthly": "M1-M",
    "monash_m1_quarterly": "M1-Q",
    "monash_m3_monthly": "M3-M",
    "monash_m3_quarterly": "M3-Q",
    "monash_tourism_monthly": "Tourism-M",
    "monash_tourism_quarterly": "Tourism-Q",
}

SUMMARY_ROWS = ["Avg. Rank", "Avg", "Top 2 Count"]


def model_order(model: Column) -> Column:
    """Place of a model in the fixed order; unknown models come last, by name."""
    place = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), model)
    return F.when(place > 0, place).otherwise(len(MODEL_ORDER) + 1)


def select_model(errors: DataFrame, groups: list[str]) -> DataFrame:
    """Models with the least inner (``selected``) and outer (``best``) error.

    Also their outer and inner errors. Ties go to the first model in order.
    """
    ordered = errors.withColumn("_order", model_order(F.col("model")))
    picked = ordered.groupBy(*groups).agg(
        first_by("inner", "_order", "model", "outer").alias("s"),
        first_by("outer", "_order", "model", "inner").alias("b"),
        F.avg(F.abs(F.col("inner") - F.col("outer"))).alias("mean_abs_diff"),
        F.avg(F.col("inner") - F.col("outer")).alias("mean_diff"))
    return picked.select(
        *groups, F.col("s.model").alias("selected"), F.col("b.model").alias("best"),
        F.col("s.outer").alias("selected_error"), F.col("b.outer").alias("best_error"),
        "mean_abs_diff", "mean_diff")


def estimation_scores(errors: DataFrame, groups: list[str]) -> DataFrame:
    """MAPEE, MPEE, Accuracy and Regret per group."""
    return select_model(errors, groups).select(
        *groups, F.col("mean_abs_diff").alias("MAPEE"), F.col("mean_diff").alias("MPEE"),
        (F.col("selected") == F.col("best")).cast("int").alias("Accuracy"),
        (F.col("selected_error") - F.col("best_error")).alias("Regret"))


def serieswise_scores(series_errors: DataFrame, groups: list[str]) -> DataFrame:
    """The same scores per series, averaged over series."""
    scores = estimation_scores(series_errors, [*groups, ID])
    return scores.groupBy(*groups).agg(
        F.avg("MAPEE").alias("mae_all"), F.avg("Accuracy").alias("accuracy"),
        F.avg("Regret").alias("regret"))


def estimation_by_model(errors: DataFrame, groups: list[str]) -> DataFrame:
    """Outer, inner, signed and absolute estimation error of every model."""
    diff = F.col("inner") - F.col("outer")
    return errors.select(
        *groups, "model", F.col("outer").alias("outer_error"), F.col("inner").alias("inner_error"),
        diff.alias("estimation_error"), F.abs(diff).alias("abs_estimation_error"))


def average_over_seeds(scores: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean of the score columns over seeds."""
    return scores.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def summarize_methods(scores: DataFrame) -> DataFrame:
    """Mean scores per method and how often, and by how much, it underestimates."""
    under, over = F.col("MPEE") < 0, F.col("MPEE") > 0
    means = scores.groupBy("method").agg(
        *[F.bround(F.avg(c), 3).alias(c) for c in ("MAPEE", "MPEE", "Accuracy", "Regret")],
        F.bround(100 * F.avg(F.when(under, 1.0).otherwise(0.0)), 2).alias("perc_underestimates"),
        F.bround(F.avg(F.when(under, F.col("MPEE"))), 3).alias("avg_under_estimate"),
        F.bround(F.avg(F.when(over, F.col("MPEE"))), 3).alias("avg_over_estimate"))
    return means.withColumn("method", label(F.col("method"), METHOD_NAMES))


def summarize_models(by_model: DataFrame) -> DataFrame:
    """Mean errors per model, ranked by outer error and by difficulty of estimation."""
    means = by_model.groupBy("model").agg(
        F.bround(F.avg("outer_error"), 3).alias("avg_outer_error"),
        F.bround(F.avg("inner_error"), 3).alias("avg_inner_error"),
        F.bround(F.avg("estimation_error"), 3).alias("mean_est_error"),
        F.bround(F.avg("abs_estimation_error"), 3).alias("mean_abs_est_error"),
        F.bround(100 * F.avg(F.when(F.col("estimation_error") < 0, 1.0).otherwise(0.0)), 1)
        .alias("perc_underestimated"))
    # One row per model: a single window task is enough.
    whole = [F.lit(0)]
    return means.select(
        "*",
        F.floor(average_rank(F.col("avg_outer_error"), whole)).cast("int").alias("outer_rank"),
        F.floor(average_rank(F.col("mean_abs_est_error"), whole, descending=True))
        .cast("int").alias("difficulty_rank")).orderBy(F.asc_nulls_last("avg_outer_error"))


def pivot_model_method(by_model: DataFrame, methods: list[str]) -> DataFrame:
    """Mean absolute estimation error, one column per method of the fixed list."""
    wide = by_model.groupBy("model").pivot("method", methods).agg(
        F.bround(F.avg("abs_estimation_error"), 3))
    return wide


def downstream_error(errors: DataFrame, groups: list[str]) -> DataFrame:
    """Outer error of the selected and the best model, and their difference."""
    return select_model(errors, groups).select(
        *groups, "selected_error", "best_error",
        (F.col("selected_error") - F.col("best_error")).alias("outer_regret"))


def method_leaderboard(downstream: DataFrame) -> DataFrame:
    """Long rows ``(dataset, method, value)``: errors plus three summary rows.

    ``Avg. Rank`` shares ties, ``Top 2 Count`` counts minimum ranks below 3; a method
    without an error has no rank in that dataset.
    """
    by_dataset = [F.col("dataset")]
    lowest = rank_known(F.col("selected_error"), by_dataset)
    ranked = downstream.select(
        "dataset", "method", "selected_error",
        average_rank(F.col("selected_error"), by_dataset).alias("rank"), lowest.alias("lowest"))
    summary = ranked.groupBy("method").agg(
        F.avg("rank").alias("Avg. Rank"), F.avg("selected_error").alias("Avg"),
        F.count_if(F.col("lowest") < 3).cast("double").alias("Top 2 Count"))
    rows = reduce(DataFrame.unionByName, [
        summary.select(F.lit(name).alias("dataset"), "method", F.col(f"`{name}`").alias("value"))
        for name in SUMMARY_ROWS])
    errors = downstream.select("dataset", "method", F.col("selected_error").alias("value"))
    return errors.unionByName(rows)


def leaderboard_table(board: DataFrame, methods: list[str]) -> DataFrame:
    """Leaderboard with one column per method, under display names."""
    wide = board.groupBy("dataset").pivot("method", methods).agg(F.first("value"))
    named = [F.col(f"`{m}`").alias(METHOD_NAMES.get(m, m)) for m in methods]
    return wide.select(label(F.col("dataset"), DATASET_NAMES).alias("dataset"), *named)


def rank_methods(outer: DataFrame) -> DataFrame:
    """Rank methods per (dataset, model), least error first; mean over both."""
    ranks = rank_known(F.col("outer"), [F.col("dataset"), F.col("model")])
    per_model = outer.withColumn("rank", ranks).groupBy("method", "model").agg(
        F.avg("rank").alias("rank"))
    return per_model.groupBy("method").agg(F.avg("rank").alias("avg_rank"))


def rank_models(outer: DataFrame) -> DataFrame:
    """Rank models per (dataset, method), least error first; mean of per-method means."""
    ranks = rank_known(F.col("outer"), [F.col("dataset"), F.col("method")])
    per_method = outer.withColumn("rank", ranks).groupBy("method", "model").agg(
        F.avg("rank").alias("rank"))
    return per_method.groupBy("model").agg(F.avg("rank").alias("avg_rank"))


def annotate_top2(board: DataFrame, digits: int = 3) -> DataFrame:
    """Mark the best and second-best distinct rounded value of each row; never a missing one."""
    rounded = board.withColumn("value", F.bround("value", digits))
    place = rank_known(F.col("value"), [F.col("dataset")], dense=True)
    return rounded.withColumn(
        "mark", F.when(place == 1, "best").when(place == 2, "second"))


def label(column: Column, names: dict[str, str]) -> Column:
    """Display name of a value; values without one pass through."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[column], column)


def round_report(table: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Round half-even, as reports do."""
    return table.withColumns({c: F.bround(c, digits) for c in columns})


def timing_summary(runs: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    """Mean, population deviation and range of repeated runs per configuration."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.bround(F.avg(value), 2).alias("mean"),
        F.bround(F.stddev_pop(value), 2).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def timing_grid(summary: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Mean times as a grid: one row per ``row``, one column per value."""
    return summary.groupBy(row).pivot(column, values).agg(F.first("mean"))


def timing_extremes(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Fastest and slowest configuration, the speedup and the share of time saved."""
    best = summary.agg(
        F.min(F.struct("mean", *keys)).alias("fast"), F.max(F.struct("mean", *keys)).alias("slow"))
    fast, slow = F.col("fast.mean"), F.col("slow.mean")
    return best.select(
        *[F.col(f"fast.{k}").alias(f"fastest_{k}") for k in keys],
        *[F.col(f"slow.{k}").alias(f"slowest_{k}") for k in keys],
        fast.alias("fastest"), slow.alias("slowest"),
        F.bround(slow / F.nullif(fast, F.lit(0.0)), 2).alias("speedup"),
        F.bround((slow - fast) / F.nullif(slow, F.lit(0.0)) * 100, 1).alias("perc_saved"))
