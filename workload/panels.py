"""The panels that the registered queries read, built from the given tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelfold.functions.exprs import clean
from panelfold.operators.shape import resample_daily, resample_hourly
from panelfold.schema import ID, TARGET, TIME

# Frequency, horizon and season of each panel.
PANELS = {
    "brand_month": {"freq": "MS", "horizon": 6, "season": 12},
    "nation_month": {"freq": "MS", "horizon": 6, "season": 12},
    "user_day": {"freq": "D", "horizon": 3, "season": 7},
    "type_hour": {"freq": "H", "horizon": 12, "season": 24},
}
MONTHLY = ["brand_month", "nation_month"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str):
    """Sum of a money column in whole cents, which no order of summation changes."""
    return F.expr(f"sum(cast(rint({column} * 100) as bigint)) / 100D").alias(TARGET)


def _settled(means: DataFrame) -> DataFrame:
    """Means to eight places: the rest depends on the order of summation."""
    return means.withColumn(TARGET, F.round(TARGET, 8))


def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias(ID),
                     F.trunc(F.to_date("l_shipdate"), "MM").alias(TIME))
            .agg(_money("l_extendedprice")))


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").cast("string").alias(ID),
                     F.trunc(F.to_date("o_orderdate"), "MM").alias(TIME))
            .agg(_money("o_totalprice")))


def user_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular observation times."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias(ID), F.col("ts").alias(TIME),
        clean(F.col("value")).alias(TARGET))


def type_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias(ID), F.col("ts").alias(TIME),
        clean(F.col("value")).alias(TARGET))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(resample_daily(user_raw(spark, sf_dir)))


def type_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(resample_hourly(type_raw(spark, sf_dir)))


BUILDERS = {"brand_month": brand_month, "nation_month": nation_month,
            "user_day": user_day, "type_hour": type_hour}


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


def stacked(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Several panels under one ``dataset`` column."""
    return reduce(DataFrame.unionByName, [
        panel(spark, sf_dir, n).select(F.lit(n).alias("dataset"), ID,
                                       F.col(TIME).cast("timestamp_ntz").alias(TIME), TARGET)
        for n in names])
