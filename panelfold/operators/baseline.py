"""The seasonal naive baseline, computed once for all folds and methods."""

from pyspark.sql import DataFrame, functions as F

from ..schema import STEP_SIZE, TARGET
from .origins import GRID, at, origins, season_position, with_leads


def seasonal_naive(positioned: DataFrame, horizon: int, season: int, test_size: int,
                   step: int = STEP_SIZE, skip_last: int = 0) -> DataFrame:
    """Repeat the last observed season: grid rows with ``yhat``.

    Null where the series starts after the needed point. (The formula of the
    baseline is public; leads beyond one season reuse its phases.)
    """
    rows = origins(positioned, horizon, test_size, step, history=season, skip_last=skip_last)
    leads = with_leads(rows, horizon)
    return leads.select(*GRID, F.expr(at(season_position(season), TARGET)).alias("yhat"))
