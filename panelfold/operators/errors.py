"""Scaled errors per series, and their means over folds and series."""

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import BASELINE, ID, POS, SIZE, TARGET
from .positions import neighbours


def mae_by_series(forecasts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean absolute error per series and model (and ``keys``)."""
    return forecasts.groupBy(*(keys or []), ID, "model").agg(
        F.avg(F.abs(F.col(TARGET) - F.col("yhat"))).alias("err"))


def zero_to_null(value: Column) -> Column:
    """A zero scale carries no information."""
    return F.nullif(value, F.lit(0.0))


def mase_scale(positioned: DataFrame, season: int, freq: str | None = None,
               holdout: int = 0) -> DataFrame:
    """Mean absolute seasonal difference per series; null where it is zero.

    ``holdout`` leaves out that many final rows of each series.
    """
    near = neighbours(positioned, freq, before=season)
    train = near.rows.filter(F.col(POS) <= F.col(SIZE) - holdout)
    change = F.abs(F.col(TARGET) - F.lag(TARGET, season).over(near.window))
    steps = near.only_core(train.withColumn("_change", change))
    return steps.groupBy(ID).agg(zero_to_null(F.avg("_change")).alias("scale"))


def mase_scale_by_season(positioned: DataFrame, id_col: str = ID) -> DataFrame:
    """``mase_scale`` where every row brings its own ``season``, such as that of its dataset.

    The value a season back is looked up by position, a key that no series makes hot.
    """
    back = positioned.select(id_col, (F.col(POS) + F.col("season")).alias(POS), F.col(TARGET).alias("_back"))
    return (positioned.join(back, [id_col, POS])
            .groupBy(id_col).agg(zero_to_null(F.avg(F.abs(F.col(TARGET) - F.col("_back")))).alias("scale")))


def scaled_errors(errors: DataFrame, scales: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Divide each series' error by its scale; series without one drop out of means."""
    on = [*(keys or []), ID]
    return errors.join(scales, on).withColumn("err", F.col("err") / F.col("scale")).drop("scale")


def mean_by_model(scaled: DataFrame, keys: list[str] | None = None,
                  baseline: str | None = BASELINE) -> DataFrame:
    """Mean over series per model; the baseline is dropped unless ``None``."""
    kept = scaled if baseline is None else scaled.filter(F.col("model") != baseline)
    return kept.groupBy(*(keys or []), "model").agg(F.avg("err").alias("err"))


def collapse_folds(errors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One error per series and model: the mean over its test appearances."""
    return errors.groupBy(*(keys or []), ID, "model").agg(F.avg("err").alias("err"))


def base_id(composite: Column) -> Column:
    """Series id of a composite id; an id that only looks like one stays whole."""
    return F.regexp_replace(composite, r"_fold[0-9]+_x[0-9]+$", "")


def inner_error_pooled(forecasts: DataFrame, scales: DataFrame,
                       keys: list[str] | None = None) -> DataFrame:
    """Inner error: per series and fold, then series, then model.

    Three levels of means, so series weigh the same however often they were
    tested.
    """
    keys = keys or []
    per_fold = mae_by_series(forecasts, [*keys, "fold"])
    scaled = scaled_errors(collapse_folds(per_fold, keys), scales, _shared(keys, scales))
    return mean_by_model(scaled, keys)


def inner_error_by_fold(forecasts: DataFrame, scales: DataFrame,
                        keys: list[str] | None = None) -> DataFrame:
    """Inner error with folds, not series, weighing the same."""
    keys = keys or []
    per_fold = mae_by_series(forecasts, [*keys, "fold"])
    scaled = scaled_errors(per_fold, scales, _shared(keys, scales))
    folds = mean_by_model(scaled, [*keys, "fold"])
    return folds.groupBy(*keys, "model").agg(F.avg("err").alias("err"))


def outer_error(forecasts: DataFrame, scales: DataFrame,
                keys: list[str] | None = None) -> DataFrame:
    """Outer error: per series over all origins, scaled, then per model."""
    keys = keys or []
    scaled = scaled_errors(mae_by_series(forecasts, keys), scales, _shared(keys, scales))
    return mean_by_model(scaled, keys)


def _shared(keys: list[str], scales: DataFrame) -> list[str]:
    return [k for k in keys if k in scales.columns]


def first_by(value: str, *rest: str) -> Column:
    """Smallest ``value`` with ties settled by ``rest``, as one struct."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(value, *rest)))
