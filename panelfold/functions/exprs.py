"""Small column expressions used across operators."""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def clean(value: Column) -> Column:
    """Missing values are NULL, never NaN."""
    value = value.cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def hash_text(*parts: Column) -> Column:
    """md5 over the parts joined by ``|``: the source of every random draw."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_number(digest: Column) -> Column:
    """First 60 bits of a digest as a number in [0, 2^60)."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_uniform(digest: Column) -> Column:
    """First 32 bits of a digest as a number in [0, 1), for draws from a short list."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def rank_known(over: Column, groups: list[Column], descending: bool = False, dense: bool = False) -> Column:
    """Rank of a value among those that are not missing; a missing one has no rank."""
    order = over.desc_nulls_last() if descending else over.asc_nulls_last()
    ranked = (F.dense_rank() if dense else F.rank()).over(Window.partitionBy(*groups).orderBy(order))
    return F.when(over.isNotNull(), ranked)


def average_rank(over: Column, groups: list[Column], descending: bool = False) -> Column:
    """Rank with ties sharing their mean, missing values left out; one window task per
    small group."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, over))
    return rank_known(over, groups, descending) + (ties - 1) / F.lit(2.0)


def inline_rows(rows: Iterable[tuple], names: list[str]) -> Column:
    """A fixed list of rows, to be multiplied onto every row of a ``select``."""
    def text(value) -> str:
        if isinstance(value, float):
            return f"{value!r}D"
        return f"'{value}'" if isinstance(value, str) else str(value)

    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {text(v)}" for n, v in zip(names, row)) + ")"
        for row in rows)
    return F.expr(f"inline(array({structs}))")


def small_table(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A fixed table as a local relation: name -> (type, values).

    Arrow input stays in the plan, so reading it starts no Python worker.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(),
             "list": pa.list_(pa.string())}
    return spark.createDataFrame(pa.table(
        {name: pa.array(values, kinds[kind]) for name, (kind, values) in columns.items()}))
