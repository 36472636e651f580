"""Choosing configurations from their losses on the folds."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import configs as C
from ..operators import linear as L
from ..schema import ID, OUT_SET_MULTIPLIER, TARGET


@dataclass(frozen=True)
class Windows:
    """How many final rows of a series each step leaves out.

    From the end of a series: the out-set, then the inner test window, then the
    validation window, each of them ``horizon`` rows but for the out-set.
    """

    horizon: int
    season: int
    out_multiplier: int = OUT_SET_MULTIPLIER

    @property
    def out(self) -> int:
        return self.horizon * self.out_multiplier

    @property
    def stages(self) -> dict[str, int]:
        """Rows unseen by the fit before validation, the inner fit and the final fit."""
        return {"val": self.out + 2 * self.horizon, "inner": self.out + self.horizon,
                "final": self.out}


def stage_sums(trended: DataFrame, windows: Windows, freq: str | None) -> DataFrame:
    """Sums of products of every stage, feature set and scaler, from one pass."""
    sums = L.training_sums(trended, windows.horizon, windows.season, windows.stages, freq)
    return L.apply_scalers(sums, L.series_widths(trended, windows.stages), windows.stages)


def stage_widths(trended: DataFrame, windows: Windows, stage: str) -> DataFrame:
    return L.series_widths(trended, {stage: windows.stages[stage]})


def stage_coefs(coefs: DataFrame, stage: str) -> DataFrame:
    return coefs.filter(F.col("stage") == stage).drop("stage", "n_windows")


def validation_loss(trended: DataFrame, coefs: DataFrame, train: DataFrame, windows: Windows,
                    groups: list[str]) -> DataFrame:
    """Mean absolute error per (groups, features, scaler) on the validation window.

    Only training series count, and only the ``horizon`` rows before the inner
    test window; the fit saw neither. Test series play no part in tuning.
    """
    inputs = L.forecast_inputs(trended, windows.horizon, windows.season, windows.horizon,
                               skip_last=windows.stages["inner"])
    rows = L.predict(inputs.join(train.select(*groups, ID), ID), stage_coefs(coefs, "val"),
                     stage_widths(trended, windows, "val"), "val", groups)
    return rows.groupBy(*groups, "features", "scaler").agg(
        F.avg(F.abs(F.col(TARGET) - F.col("yhat"))).alias("loss"))


def score_configs(losses: DataFrame, configs: DataFrame, groups: list[str]) -> DataFrame:
    """Loss of every sampled configuration in every fold, with its hash.

    Both sides have a number of rows set by folds and configurations.
    """
    trials = C.effective_model(configs).join(losses, ["features", "scaler"])
    return C.config_scores(trials).select(
        *groups, "model", "family", "config_idx", "loss", "config", "hash_value",
        "features", "scaler")
