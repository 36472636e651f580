"""Pruning, sampling, splitting and resampling of long panels."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import next_time, truncate_hour
from ..functions.exprs import clean, hash_text, inline_rows
from ..schema import ID, OUT_SET_MULTIPLIER, POS, SEED, SIZE, TARGET, TIME
from ..session import materialize
from .medians import medians
from .positions import neighbours, series_sizes, with_positions
from .ranks import hash_rank


# -- series filters ---------------------------------------------------------

def filter_series(panel: DataFrame, series: DataFrame, id_col: str = ID) -> DataFrame:
    """Rows whose series is in ``series``.

    A semi join: Spark broadcasts the ids when they turn out small, else joins
    by shuffle and splits a hot series across tasks (adaptive skew join).
    """
    return panel.join(series.select(id_col), id_col, "left_semi")


def prune_short_series(panel: DataFrame, min_n_instances: int, id_col: str = ID) -> DataFrame:
    """Keep series with at least ``min_n_instances`` rows."""
    large = series_sizes(panel, id_col).filter(F.col(SIZE) >= min_n_instances)
    return filter_series(panel, large, id_col)


def sample_first_uids(panel: DataFrame, n_uid: int, id_col: str = ID) -> DataFrame:
    """Keep the first ``n_uid`` series in id order."""
    first = panel.select(id_col).distinct().orderBy(id_col).limit(n_uid)
    return filter_series(panel, first, id_col)


def sampled_series(series: DataFrame, frac_uid: float, seed: int = SEED,
                   id_col: str = ID) -> DataFrame:
    """A random share of the series: exact size (half-even), no replacement."""
    return sampled_per_seed(series, frac_uid, [seed], id_col).drop("seed")


def sampled_per_seed(series: DataFrame, frac_uid: float, seeds: list[int],
                     id_col: str = ID) -> DataFrame:
    """Rows ``(seed, id)``: an independent share of the series for every seed."""
    drawn = series.select(id_col).distinct().select(
        id_col, inline_rows([(s,) for s in seeds], ["seed"]))
    digest = hash_text(F.col("seed"), F.lit("sample"), F.col(id_col))
    ranked = hash_rank(drawn, digest, ["seed"], id_col)
    kept = F.bround(F.col("total") * F.lit(float(frac_uid)), 0)
    return ranked.filter(F.col("rank") <= kept).select("seed", id_col)


def sample_uids(panel: DataFrame, frac_uid: float, seed: int = SEED, id_col: str = ID) -> DataFrame:
    """Rows of a random share of the series."""
    return filter_series(panel, sampled_series(panel, frac_uid, seed, id_col), id_col)


# -- values within a series -------------------------------------------------

def dummify_series(panel: DataFrame, freq: str | None = None, id_col: str = ID,
                   time_col: str = TIME, target_col: str = TARGET) -> DataFrame:
    """Replace the target by 0, 1, 2, ... in time order."""
    return (with_positions(panel, freq, id_col, time_col)
            .withColumn(target_col, (F.col(POS) - 1).cast("double")).drop(POS, SIZE))


def difference_series(panel: DataFrame, freq: str | None = None, id_col: str = ID,
                      time_col: str = TIME, target_col: str = TARGET) -> DataFrame:
    """First differences; the first row of each series is dropped, later nulls stay."""
    near = neighbours(with_positions(panel, freq, id_col, time_col), freq, before=1, id_col=id_col)
    diff = near.rows.withColumn(
        target_col, F.col(target_col) - F.lag(target_col, 1).over(near.window))
    return near.only_core(diff).filter(F.col(POS) > 1).drop(POS, SIZE)


# -- splits in time ---------------------------------------------------------

def uid_tails(panel: DataFrame, tail_size: int, freq: str | None = None, id_col: str = ID,
              time_col: str = TIME) -> DataFrame:
    """Last ``tail_size`` rows of every series."""
    rows = with_positions(panel, freq, id_col, time_col)
    return rows.filter(F.col(POS) > F.col(SIZE) - tail_size).drop(POS, SIZE)


def label_time_split(panel: DataFrame, horizon: int, freq: str | None = None, id_col: str = ID,
                     time_col: str = TIME) -> DataFrame:
    """Add ``part``: the last ``horizon`` rows are test, earlier rows train.

    A series with no more than ``horizon`` rows is all test.
    """
    rows = with_positions(panel, freq, id_col, time_col)
    part = F.when(F.col(POS) > F.col(SIZE) - horizon, "test").otherwise("train")
    return rows.withColumn("part", part).drop(POS, SIZE)


def time_wise_split(panel: DataFrame, horizon: int, freq: str | None = None, id_col: str = ID,
                    time_col: str = TIME) -> tuple[DataFrame, DataFrame]:
    """The two halves of :func:`label_time_split` as separate frames."""
    labelled = label_time_split(panel, horizon, freq, id_col, time_col)
    return (labelled.filter(F.col("part") == "train").drop("part"),
            labelled.filter(F.col("part") == "test").drop("part"))


def nested_parts(horizon: int, out_multiplier: int = OUT_SET_MULTIPLIER) -> Column:
    """Part of a positioned row: ``dev``, ``in`` (rest of the in-set) or ``out``."""
    from_end = F.col(SIZE) - F.col(POS)
    return (F.when(from_end < horizon * out_multiplier, "out")
            .when(from_end < horizon * (out_multiplier + 1), "in").otherwise("dev"))


def nested_time_split(panel: DataFrame, horizon: int, freq: str | None = None,
                      out_multiplier: int = OUT_SET_MULTIPLIER, id_col: str = ID,
                      time_col: str = TIME) -> DataFrame:
    """Label out-set, validation end of the in-set and dev-set in one pass."""
    return (with_positions(panel, freq, id_col, time_col)
            .withColumn("part", nested_parts(horizon, out_multiplier)).drop(POS, SIZE))


def concat_time_wise(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of both parts; order them only where they are written out."""
    return train.unionByName(test)


def outset_series_holdout(panel: DataFrame, horizon: int, freq: str | None = None,
                          fraction: float = 0.3, seed: int = SEED,
                          out_multiplier: int = OUT_SET_MULTIPLIER) -> DataFrame:
    """Label rows for the nested experiment.

    ``in_set`` marks in-set rows of the sampled 1 - ``fraction`` of the series;
    the final evaluation uses every row.
    """
    labelled = nested_time_split(panel, horizon, freq, out_multiplier)
    kept = sampled_series(panel, 1 - fraction, seed).withColumn("_kept", F.lit(True))
    return (labelled.join(kept, ID, "left")
            .withColumn("in_set", F.col("_kept").isNotNull() & (F.col("part") != "out"))
            .drop("_kept"))


# -- resampling -------------------------------------------------------------

def _mean_per(raw: DataFrame, time: Column, id_col: str, time_col: str,
              target_col: str) -> DataFrame:
    return raw.groupBy(id_col, time.alias(time_col)).agg(
        F.avg(clean(F.col(target_col))).alias(target_col))


def _fill_gaps(regular: DataFrame, step: str, id_col: str, time_col: str,
               target_col: str) -> DataFrame:
    """Insert the missing steps between neighbours as rows with a null target.

    Needs one window and no join: every row also emits the gap that follows it, year
    by year, so one stray time makes no array of millions of steps. The window reads
    ahead by one row only.
    """
    series = Window.partitionBy(id_col).orderBy(time_col)
    here = F.col(time_col)
    kind = regular.schema[time_col].dataType.simpleString()
    unit = F.expr(f"INTERVAL '1' {step}")
    upto = F.coalesce(F.lead(time_col).over(series) - unit, here)
    first = F.greatest(here, F.expr(f"cast(make_date(_year, 1, 1) as {kind})"))
    last = F.least(F.col("_upto"), F.expr(f"cast(make_date(_year + 1, 1, 1) as {kind})") - unit)
    return (
        regular.withColumn("_upto", upto)
        .withColumn("_year", F.explode(F.sequence(F.year(here), F.year("_upto"))))
        .withColumn("_time", F.explode(F.when(first <= last, F.sequence(first, last, unit))))
        .select(id_col, F.col("_time").alias(time_col),
                F.when(F.col("_time") == here, F.col(target_col)).alias(target_col)))


def resample_daily(raw: DataFrame, id_col: str = ID, time_col: str = TIME,
                   target_col: str = TARGET) -> DataFrame:
    """Mean per series and day, dense from the first to the last day."""
    daily = _mean_per(raw, F.to_date(time_col), id_col, time_col, target_col)
    return _fill_gaps(daily, "DAY", id_col, time_col, target_col)


def resample_hourly(raw: DataFrame, id_col: str = ID, time_col: str = TIME,
                    target_col: str = TARGET) -> DataFrame:
    """Mean per series and hour, dense from the first to the last hour."""
    hourly = _mean_per(raw, truncate_hour(F.col(time_col)), id_col, time_col, target_col)
    return _fill_gaps(hourly, "HOUR", id_col, time_col, target_col)


# -- checks and summaries ---------------------------------------------------

def validate_frequency(panel: DataFrame, freq: str, id_col: str = ID,
                       time_col: str = TIME) -> DataFrame:
    """Series whose time steps disagree with ``freq``, with the number of bad steps.

    A row is bad if the next row of its series is not exactly one step later.
    That needs no order: look up (series, next time), a key no series can make
    hot, and take off the last row. Duplicate times count as bad steps.
    """
    times = panel.groupBy(id_col, time_col).agg(F.count(F.lit(1)).alias("_copies"))
    follows = times.select(id_col, F.col(time_col).alias("_next"), F.lit(True).alias("_found"))
    checked = times.withColumn("_next", next_time(F.col(time_col), freq)).join(
        follows, [id_col, "_next"], "left")
    lone = F.sum(F.when(F.col("_found").isNull(), 1).otherwise(0)) - 1
    return (checked.groupBy(id_col)
            .agg(F.sum("_copies").alias("n_rows"),
                 (lone + F.sum(F.col("_copies") - 1)).alias("n_bad_steps"))
            .filter(F.col("n_bad_steps") > 0))


def min_size_check(panel: DataFrame, val_size: int, test_size: int, id_col: str = ID) -> DataFrame:
    """Series too short for a validation and a test window."""
    return series_sizes(panel, id_col).filter(F.col(SIZE) < val_size + test_size)


def panel_summary(panels: DataFrame, params: DataFrame, id_col: str = ID) -> DataFrame:
    """Horizon, input size, rows and series per dataset of a stacked panel."""
    # Two-level count: distinct series first, so no exact distinct per dataset
    # has to be held by one task.
    per_series = panels.groupBy("dataset", id_col).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = per_series.groupBy("dataset").agg(
        F.sum("_rows").alias("n_obs"), F.count(F.lit(1)).alias("n_series"))
    return sizes.join(
        params.select("dataset", "horizon", F.col("n_lags").alias("input_size")), "dataset", "left"
    ).select("dataset", "horizon", "input_size", "n_obs", "n_series")


# -- scaling ----------------------------------------------------------------

def scale_statistics(positioned: DataFrame, kind: str, holdout: int,
                     id_col: str = ID, target_col: str = TARGET) -> DataFrame:
    """Centre and width per series over all rows but the last ``holdout``.

    The scope of the scaler is a choice of this library: the train part of each
    series. ``robust`` takes the exact median and the exact median deviation from it, by
    selection (``medians``); experiments map it to standard.
    """
    train = positioned.filter(F.col(POS) <= F.col(SIZE) - holdout)
    if kind == "standard":
        return train.groupBy(id_col).agg(
            F.avg(target_col).alias("centre"),
            F.nullif(F.stddev_pop(target_col), F.lit(0.0)).alias("width"))
    if kind != "robust":
        raise ValueError(f"unknown scaler {kind!r}")
    values = materialize(train.select(id_col, F.col(target_col).alias("_y")), "values")
    centre = materialize(medians(values, id_col, "_y").withColumnRenamed("median", "centre"), "centres")
    away = values.join(centre, id_col).select(id_col, F.abs(F.col("_y") - F.col("centre")).alias("_away"))
    return centre.join(medians(away, id_col, "_away"), id_col).select(
        id_col, "centre", F.nullif("median", F.lit(0.0)).alias("width"))


def scale_series(positioned: DataFrame, statistics: DataFrame, id_col: str = ID,
                 target_col: str = TARGET) -> DataFrame:
    """Add ``scaled``; a series without width stays null."""
    return positioned.join(statistics, id_col).withColumn(
        "scaled", (F.col(target_col) - F.col("centre")) / F.col("width"))


def unscale(scaled: Column) -> Column:
    """Back to the original units, given ``centre`` and ``width``."""
    return scaled * F.col("width") + F.col("centre")
