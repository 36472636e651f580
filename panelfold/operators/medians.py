"""Exact medians without holding a group's values together."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# Ranges that a group's values are counted in, each round.
BUCKETS = 1024


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """Range of a value between ``low`` and ``high``; grows with the value, 0 to BUCKETS - 1.

    Halves are subtracted, so that the width of no range overflows.
    """
    share = (value / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    return F.least(F.coalesce(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, median``: the median of each group's values, exactly.

    The two middle ranks are narrowed to a range of values, round by round: each
    round counts the values of a group in ``BUCKETS`` parts of its range, sums the counts
    before the shuffle, and keeps the part that holds the ranks, until it holds one
    value, or the ranks fall into two parts, whose ends they are then. A
    range keeps its ends as values that occur, so every round shrinks it. No task
    holds more than ``BUCKETS`` counts of a group, however many values that has. Null values
    and NaN are left out; a group of nothing else has a null median.
    """
    rows = materialize(rows.select(key, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")), "values")
    ends = rows.groupBy(key).agg(F.count("_v").alias("_n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    # Ranks from 1 within the range: the lower and the upper middle.
    left = materialize(ends.select(key, "low", "high", F.floor((F.col("_n") + 1) / 2).alias("r1"),
                                   F.floor((F.col("_n") + 2) / 2).alias("r2")), "ranges")
    settled = []
    while True:
        done = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
        settled.append(left.filter(done).select(key, F.col("low").alias("median")))
        left = left.filter(~done)
        if left.isEmpty():
            break
        part = _bucket(F.col("_v"), F.col("low"), F.col("high"))
        counts = (rows.join(left, key).filter("_v between low and high")
                  .groupBy(key, "r1", "r2", part.alias("_part"))
                  .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
        upto = F.sum("_n").over(Window.partitionBy(key).orderBy("_part"))
        held = counts.withColumn("_before", upto - F.col("_n"))
        first = (F.col("r1") > F.col("_before")) & (F.col("r1") <= F.col("_before") + F.col("_n"))
        second = (F.col("r2") > F.col("_before")) & (F.col("r2") <= F.col("_before") + F.col("_n"))
        found = materialize(held.filter(first | second).groupBy(key).agg(
            F.count(F.lit(1)).alias("_parts"), F.max(F.when(first, F.col("high"))).alias("_top"),
            F.min(F.when(second, F.col("low"))).alias("_bottom"), F.min("low").alias("low"),
            F.max("high").alias("high"), F.min(F.col("r1") - F.col("_before")).alias("r1"),
            F.min(F.col("r2") - F.col("_before")).alias("r2")), "ranges")
        settled.append(found.filter("_parts = 2").select(key, (F.col("_top") / 2 + F.col("_bottom") / 2).alias("median")))
        left = found.filter("_parts = 1").select(key, "low", "high", "r1", "r2")
    return reduce(DataFrame.unionByName, settled)
