"""The frequency of a panel, taken from the times in it."""

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.positions import neighbours, with_positions
from ..schema import ID, POS, TIME

# Seconds of a mean month, to compare a step in months with one in seconds.
MONTH_SECONDS = 2_629_746


def _at_month_end(time: Column) -> Column:
    return time.cast("date") == F.last_day(time)


def time_steps(panels: DataFrame, key: str = "dataset", id_col: str = ID, time_col: str = TIME) -> DataFrame:
    """``key, unit, k``: the step from every time of a series to its next one.

    A step between equal places in a month (the same day, or both the last one) is a
    number of months, any other one a number of seconds. Repeated times count once.
    """
    series = F.concat_ws("\x1f", F.col(key), F.col(id_col))
    times = (panels.select(key, series.alias("_series"), F.col(time_col).cast("timestamp_ntz").alias("_time"))
             .filter("_time is not null").distinct())
    near = neighbours(with_positions(times, None, "_series", "_time"), None, after=1, id_col="_series")
    pairs = near.only_core(near.rows.withColumn("_next", F.lead("_time").over(near.window)))
    time, later = F.col("_time"), F.col("_next")
    months = (F.year(later) - F.year(time)) * 12 + F.month(later) - F.month(time)
    clock = F.timestamp_diff("SECOND", F.date_trunc("DAY", time), time) == F.timestamp_diff(
        "SECOND", F.date_trunc("DAY", later), later)
    same = clock & ((F.dayofmonth(time) == F.dayofmonth(later)) | (_at_month_end(time) & _at_month_end(later)))
    by_month = (months > 0) & same
    return pairs.filter("_next is not null").select(
        key, F.when(by_month, "month").otherwise("second").alias("unit"),
        F.when(by_month, months.cast("long")).otherwise(F.timestamp_diff("SECOND", time, later)).alias("k"))


def _code(unit: Column, k: Column, monthly: Column) -> Column:
    """Text of a step: the coarsest unit that divides it, with its multiple where not one."""
    def named(size: int, code) -> Column:
        times = F.floor(k / size).cast("string")
        return F.concat(F.when(k == size, "").otherwise(times), code if isinstance(code, Column) else F.lit(code))

    def whole(size: int) -> Column:
        return k % size == 0

    return (F.when(unit == "month", F.when(whole(12), named(12, "Y")).when(whole(3), named(3, "Q"))
                   .otherwise(named(1, monthly)))
            .when(whole(604800), named(604800, "W")).when(whole(86400), named(86400, "D"))
            .when(whole(3600), named(3600, "H")).when(whole(60), named(60, "T")).otherwise(named(1, "S")))


def infer_frequency(panels: DataFrame, key: str = "dataset", id_col: str = ID,
                    time_col: str = TIME) -> DataFrame:
    """``key, freq``: the commonest step of every dataset as a frequency code.

    Equally common steps: the shorter one. Monthly steps are ``MS`` where all times
    start a month, ``ME`` where all end one, else ``M``. A dataset whose series have one
    time each has no frequency. Steps are counted before they are compared, so a long
    series is no window task (``positions``).
    """
    counts = time_steps(panels, key, id_col, time_col).groupBy(key, "unit", "k").agg(F.count(F.lit(1)).alias("_times"))
    length = F.when(F.col("unit") == "month", F.col("k") * MONTH_SECONDS).otherwise(F.col("k"))
    best = counts.groupBy(key).agg(
        F.max(F.struct("_times", (-length).alias("_shorter"), "unit", "k")).alias("_best"))
    time = F.col(time_col).cast("timestamp_ntz")
    anchors = panels.filter(F.col(time_col).isNotNull()).groupBy(key).agg(
        F.min((F.dayofmonth(time) == 1).cast("int")).alias("_starts"),
        F.min(_at_month_end(time).cast("int")).alias("_ends"))
    monthly = F.when(F.col("_starts") == 1, "MS").when(F.col("_ends") == 1, "ME").otherwise("M")
    names = panels.select(key).distinct()
    return (names.join(anchors, key, "left").join(best, key, "left")
            .select(key, _code(F.col("_best.unit"), F.col("_best.k"), monthly).alias("freq")))
