"""Reading panels: long and nested layouts, column names and time texts."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import clean
from ..operators.positions import series_sizes
from ..operators.shape import filter_series, resample_daily, resample_hourly
from ..schema import ID, SIZE, TARGET, TIME
from .params import (FREQUENCY, KEPT_AS_IS, LONG_HORIZON, RESAMPLED, dataset_params,
                     long_horizon_params)

# Column names of the nested source layout.
SOURCE_COLUMNS = {"id": ID, "timestamp": TIME, "target": TARGET}
UNUSED_COLUMNS = ["category"]

# The time range of nanosecond timestamps.
FIRST_TIME = "1677-09-21 00:12:44"
LAST_TIME = "2262-04-11 23:47:16"


def load_panel(source: DataFrame, id_col: str, time_col: str, target_col: str,
               min_n_instances: int | None = None,
               sample_n_uid: int | None = None) -> DataFrame:
    """A long panel from any table: typed, without NaN, pruned and cut to n series."""
    panel = source.select(
        F.col(id_col).cast("string").alias(ID), F.col(time_col).alias(TIME),
        clean(F.col(target_col)).alias(TARGET))
    if min_n_instances is None and sample_n_uid is None:
        return panel
    # Both conditions settle on the ids first, so the rows pass one join only.
    kept = series_sizes(panel)
    if min_n_instances is not None:
        kept = kept.filter(F.col(SIZE) >= min_n_instances)
    if sample_n_uid is not None:
        kept = kept.orderBy(ID).limit(sample_n_uid)
    return filter_series(panel, kept)


def read_panel(spark: SparkSession, path: str, group: str, time_type: T.DataType | None = None,
               min_n_instances: int | None = None,
               sample_n_uid: int | None = None, resample_to: str | None = None) -> DataFrame:
    """Read the panel of a known dataset from ``<path>/<group>`` (parquet).

    The scan declares its schema and reads the three panel columns only. With
    ``resample_to`` ("D" or "H", long-horizon datasets only) it becomes a daily or hourly
    panel of means, unless it is no finer than that; ``panel_params`` has the
    parameters that go with it.
    """
    if group not in FREQUENCY and group not in LONG_HORIZON:
        raise ValueError(f"unknown dataset {group!r}")
    if resample_to is not None and (resample_to not in RESAMPLED or group not in LONG_HORIZON):
        raise ValueError(f"cannot resample {group!r} to {resample_to!r}")
    schema = T.StructType([
        T.StructField(ID, T.StringType()),
        T.StructField(TIME, time_type or T.TimestampNTZType()),
        T.StructField(TARGET, T.DoubleType())])
    rows = spark.read.schema(schema).parquet(f"{path}/{group}")
    panel = load_panel(rows, ID, TIME, TARGET, min_n_instances, sample_n_uid)
    if resample_to is None or group in KEPT_AS_IS[resample_to]:
        return panel
    return resample_daily(panel) if resample_to == "D" else resample_hourly(panel)


def panel_params(spark: SparkSession, group: str, resample_to: str | None = None) -> DataFrame:
    """The one row ``dataset, freq, horizon, n_lags, season`` of what ``read_panel`` reads."""
    known = long_horizon_params(spark, resample_to) if group in LONG_HORIZON else dataset_params(spark)
    return known.filter(F.col("dataset") == group)


def explode_nested(nested: DataFrame, sequences: list[str] | None = None) -> DataFrame:
    """One row per element of the array columns, all exploded together.

    A table without times gets the element's place as ``position``.
    """
    arrays = sequences or [f.name for f in nested.schema.fields
                           if isinstance(f.dataType, T.ArrayType)]
    others = [c for c in nested.columns if c not in arrays]
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    if len(arrays) > 1:
        return nested.select(*others, F.inline(zipped))
    return nested.select(*others, F.posexplode(arrays[0]).alias("position", arrays[0]))


def conform_columns(frame: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Panel column names; columns no step uses are dropped."""
    return frame.withColumnsRenamed(names or SOURCE_COLUMNS).drop(*UNUSED_COLUMNS)


def _parsed(text: Column) -> Column:
    # Straight to a time without zone: the session's zone plays no part.
    time = text.try_cast("timestamp_ntz")
    return F.when(time.between(F.lit(FIRST_TIME).cast("timestamp_ntz"),
                               F.lit(LAST_TIME).cast("timestamp_ntz")), time)


def parse_timestamps(frame: DataFrame, time_col: str = TIME,
                     dataset_col: str | None = None) -> DataFrame:
    """Parse time texts.

    If all times of a dataset parse, they keep their time of day. If any does
    not (or is out of range), bad ones become null and the others are cut to
    their date. Which case holds is one flag per dataset.
    """
    parsed = frame.withColumn("_time", _parsed(F.col(time_col)))
    key = F.lit(1) if dataset_col is None else F.col(dataset_col)
    parsed = parsed.withColumn("_key", key)
    flags = parsed.groupBy(F.col("_key").alias("_flagged")).agg(F.bool_or(F.col("_time").isNull()).alias("_bad"))
    day = F.col("_time").cast("date").cast("timestamp_ntz")
    return (parsed.join(flags, F.col("_key").eqNullSafe(F.col("_flagged")))
            .withColumn(time_col, F.when(F.col("_bad"), day).otherwise(F.col("_time")))
            .drop("_time", "_key", "_flagged", "_bad"))
