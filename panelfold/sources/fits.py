"""Fitted global linear models, stored and loaded by path."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# What a fit needs for scoring, after the columns that name its group.
COEFFICIENTS = {"features": "string", "scaler": "string", "stage": "string", "lead": "int",
                "n_windows": "bigint", "b1": "double", "b2": "double", "a": "double"}


def _schema(groups: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in {**groups, **COEFFICIENTS}.items()))


def save_fit(coefs: DataFrame, path: str, groups: dict[str, str]) -> None:
    """Write the coefficients of a fit; ``groups`` are its other columns and their types."""
    schema = _schema(groups)
    (coefs.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
     .write.mode("overwrite").parquet(path))


def load_fit(spark: SparkSession, path: str, groups: dict[str, str], stage: str | None = None) -> DataFrame:
    """Coefficients as stored, with a declared schema; one ``stage``, ready to predict with."""
    stored = spark.read.schema(_schema(groups)).parquet(path)
    if stage is None:
        return stored
    return stored.filter(F.col("stage") == stage).drop("stage", "n_windows")
