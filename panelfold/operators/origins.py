"""Rolling-origin evaluation: forecast origins, grids and their actuals.

An origin is a cutoff position ``c`` of a series; lead ``k`` is the point
``c + k``. Origins only exist in the last ``test_size`` rows of a series, so a
grid reads the tail of each series (a length set by parameters, not by data)
as one array and looks every value up by position: one shuffle, no joins.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import ID, OUT_SET_MULTIPLIER, POS, SIZE, STEP_SIZE, TARGET, TIME
from ..session import ensure_checkpoint_dir


def origins(positioned: DataFrame, horizon: int, test_size: int, step: int = STEP_SIZE,
            history: int = 1, skip_last: int = 0, extra: list[str] | None = None) -> DataFrame:
    """One row per (series, cutoff): ``unique_id, n, c, cutoff, points``.

    ``points`` holds the rows from ``history`` points up to the first cutoff to
    the end of the test window, ordered by position. ``skip_last`` leaves out
    that many final rows of each series, so inner windows come from the same
    positions as outer ones. ``extra`` names further columns to keep per point.

    Short series: which windows a short series yields is a choice of this
    library: an origin needs at least one observation up to it, so cutoffs
    before the first row are left out.
    """
    end = F.col(SIZE) - skip_last
    first_cutoff = end - test_size
    tail = positioned.filter(
        (F.col(POS) > first_cutoff - history) & (F.col(POS) <= end))
    # At most history + test_size rows per series.
    series = tail.groupBy(ID).agg(
        F.max(SIZE).alias(SIZE),
        F.sort_array(F.collect_list(
            F.struct(POS, TIME, TARGET, *(extra or [])))).alias("points"))
    cutoffs = F.sequence(first_cutoff, end - horizon, F.lit(step).cast("long"))
    # A window needs test_size >= horizon; a negative cutoff is no origin.
    if test_size < horizon:
        raise ValueError("test_size must be at least the horizon")
    rows = series.withColumn("c", F.explode(cutoffs)).filter(F.col("c") >= 1)
    return rows.withColumn("cutoff", F.expr(at("c", TIME)))


def at(position: str, field: str) -> str:
    """SQL text: ``field`` of the point at ``position``, null outside of ``points``."""
    return f"get(points, cast({position} - get(points, 0).{POS} as int)).{field}"


def season_position(season: int, back: int = 1) -> str:
    """SQL text: position in the season phase of ``lead``, ``back`` seasons ago."""
    return f"(c - {season * back} + (lead - 1) % {season} + 1)"


def with_leads(origin_rows: DataFrame, horizon: int) -> DataFrame:
    """One row per (series, cutoff, lead) with the time and actual of the lead."""
    rows = origin_rows.withColumn("lead", F.expr(f"explode(sequence(1, {horizon}))"))
    return rows.withColumns({TIME: F.expr(at("c + lead", TIME)),
                             TARGET: F.expr(at("c + lead", TARGET))})


GRID = [ID, "cutoff", TIME, "lead", TARGET]


def cv_grid(positioned: DataFrame, horizon: int, test_size: int, step: int = STEP_SIZE) -> DataFrame:
    """Every (series, cutoff, time) to forecast, with its actual."""
    return with_leads(origins(positioned, horizon, test_size, step), horizon).select(GRID)


def cv_inner(positioned_in_set: DataFrame, horizon: int) -> DataFrame:
    """Grid of the inner evaluation: one origin, ``horizon`` rows before the end."""
    return cv_grid(positioned_in_set, horizon, horizon)


def cv_outer(positioned: DataFrame, horizon: int,
             out_multiplier: int = OUT_SET_MULTIPLIER) -> DataFrame:
    """Grid of the outer evaluation: overlapping origins over the out-set."""
    return cv_grid(positioned, horizon, horizon * out_multiplier)


def attach_actuals(grid: DataFrame, panel: DataFrame) -> DataFrame:
    """Left join of the observed target onto forecasts, by series and time."""
    return grid.drop(TARGET).join(panel.select(ID, TIME, TARGET), [ID, TIME], "left")


def attach_baseline(forecasts: DataFrame, baseline: DataFrame, name: str,
                    how: str = "inner") -> DataFrame:
    """Add the baseline's forecast as a column.

    ``inner`` matches series, time and cutoff; ``left`` matches series and time
    only, for grids with one origin per series.
    """
    keys = [ID, TIME, "cutoff"] if how == "inner" else [ID, TIME]
    return forecasts.join(baseline.select(*keys, F.col("yhat").alias(name)), keys, how)


def merge_model_columns(forecasts: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Wide form of long forecasts: one column per model, from a fixed list."""
    return forecasts.groupBy(*keys).pivot("model", models).agg(F.first("yhat"))


def composite_ids(rows: DataFrame) -> DataFrame:
    """Add ``grp`` and ``composite_id`` = ``<id>_fold<fold>_x<grp>``.

    ``grp`` numbers the distinct (fold, id) pairs in order. The pairs are sorted
    across tasks by range partitioning and written once, so that the partition
    each pair fell into stays fixed; positions inside a partition are shifted by
    the counts of the partitions before it.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    pairs = (rows.select("fold", ID).distinct().repartitionByRange("fold", ID)
             .withColumn("_part", F.spark_partition_id()).checkpoint())
    # One row per partition.
    counts = pairs.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    running = Window.partitionBy(F.lit(0)).orderBy("_part")
    starts = counts.select("_part", (F.sum("_rows").over(running) - F.col("_rows")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("fold", ID)
    numbered = (
        pairs.withColumn("_row", F.row_number().over(inside)).join(starts, "_part")
        .select("fold", ID, (F.col("_before") + F.col("_row") - 1).alias("grp")))
    name = F.concat(F.col(ID), F.lit("_fold"), F.col("fold").cast("string"),
                    F.lit("_x"), F.col("grp").cast("string"))
    return rows.join(numbered, ["fold", ID]).withColumn("composite_id", name)
