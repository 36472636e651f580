"""From stored forecasts to scores per (seed, dataset, method), in one plan."""

from pyspark.sql import DataFrame, functions as F

from ..operators import errors as E
from ..schema import ID

RUN = ["seed", "dataset", "method"]


def scale_tables(positioned: DataFrame, dataset: str, season: int, horizon: int,
                 freq: str | None, out_multiplier: int = 2) -> DataFrame:
    """Error scales of a panel: ``in`` for outer errors, ``dev`` for inner ones."""
    parts = {"in": horizon * out_multiplier, "dev": horizon * (out_multiplier + 1)}
    tables = [E.mase_scale(positioned, season, freq, hold).withColumn("part", F.lit(part))
              for part, hold in parts.items()]
    return tables[0].unionByName(tables[1]).withColumn("dataset", F.lit(dataset))


def model_errors(results: DataFrame, scales: DataFrame, inner_part: str = "dev",
                 by_fold: bool = False) -> DataFrame:
    """``inner`` and ``outer`` mean scaled error per (seed, dataset, method, model).

    ``results`` holds long forecasts of both stages. Reports differ in the part
    that scales inner errors and in how folds are weighted.
    """
    scale = {part: scales.filter(F.col("part") == part).drop("part") for part in ("in", "dev")}
    stage = {s: results.filter(F.col("stage") == s) for s in ("inner", "outer")}
    pooled = E.inner_error_by_fold if by_fold else E.inner_error_pooled
    inner = pooled(stage["inner"], scale[inner_part], RUN).withColumnRenamed("err", "inner")
    outer = E.outer_error(stage["outer"], scale["in"], RUN).withColumnRenamed("err", "outer")
    return inner.join(outer, [*RUN, "model"])


def series_errors(results: DataFrame, scales: DataFrame, inner_part: str = "in") -> DataFrame:
    """``inner`` and ``outer`` scaled error per series and model."""
    scale = {part: scales.filter(F.col("part") == part).drop("part") for part in ("in", "dev")}
    keys = [*RUN, ID]
    on = ["dataset"]
    fold = E.mae_by_series(results.filter(F.col("stage") == "inner"), [*RUN, "fold"])
    inner = E.scaled_errors(E.collapse_folds(fold, RUN), scale[inner_part], on)
    outer = E.scaled_errors(
        E.mae_by_series(results.filter(F.col("stage") == "outer"), RUN), scale["in"], on)
    kept = F.col("model") != E.BASELINE
    return (inner.filter(kept).withColumnRenamed("err", "inner")
            .join(outer.filter(kept).withColumnRenamed("err", "outer"), [*keys, "model"]))
