"""Carry a table's other columns through an operator, whatever their names."""

from pyspark.sql import DataFrame, functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def narrow(rows: DataFrame, *names: str) -> DataFrame:
    """``names`` and one struct ``_rest`` of all other columns."""
    other = [F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(rows.columns) if c not in names]
    return rows.select(*names, (F.struct(*other) if other else F.lit(None).cast("int")).alias("_rest"))


def widen(rows: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """The columns that ``narrow`` was given, in their order."""
    return rows.select(*[F.col(c) if c in names else F.col(f"_rest.c{i}").alias(c)
                         for i, c in enumerate(columns)])
