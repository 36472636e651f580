"""Dataset parameters: frequency, horizon, input size and season per dataset."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import small_table

# Horizon per frequency, and for datasets of the M4 competition.
HORIZON = {"Y": 3, "Q": 4, "M": 12, "MS": 12, "ME": 12, "W": 8, "D": 30, "H": 48, "T": 48, "S": 60}
M4_HORIZON = {"Y": 6, "Q": 4, "M": 12, "MS": 12, "ME": 12, "W": 13, "D": 14, "H": 48}

# Season length per frequency.
SEASON = {"Y": 1, "Q": 4, "M": 12, "MS": 12, "ME": 12, "W": 52, "D": 365, "H": 24, "T": 1, "S": 1}

# Datasets whose series are too short for the usual horizon.
SPECIAL_HORIZON = {
    "monash_m1_monthly": 6,
    "monash_m1_quarterly": 2,
    "monash_m1_yearly": 2,
    "monash_tourism_yearly": 2,
    "m4_yearly": 3,
}

# Frequency of every known dataset.
FREQUENCY = {
    "monash_m1_monthly": "M",
    "monash_m1_quarterly": "Q",
    "monash_m1_yearly": "Y",
    "monash_m3_monthly": "M",
    "monash_m3_quarterly": "Q",
    "monash_m3_yearly": "Y",
    "monash_tourism_monthly": "M",
    "monash_tourism_quarterly": "Q",
    "monash_tourism_yearly": "Y",
    "m4_hourly": "H",
    "m4_monthly": "M",
    "m4_quarterly": "Q",
    "m4_weekly": "W",
    "m4_daily": "D",
    "m4_yearly": "Y",
    "monash_hospital": "MS",
    "monash_car_parts": "MS",
}

# Long-horizon datasets, (frequency, horizon, season).
LONG_HORIZON = {
    "ETTm1": ("15T", 96, 96),
    "ETTm2": ("15T", 96, 96),
    "ECL": ("H", 96, 24),
    "Exchange": ("D", 14, 365),
    "TrafficL": ("H", 96, 24),
    "Weather": ("10T", 144, 240),
}

# Fixed values: (frequency, horizon, season) after resampling, and the
# long-horizon datasets that are already at or above that frequency.
RESAMPLED = {"D": ("D", 14, 365), "H": ("H", 48, 24)}
KEPT_AS_IS = {"D": ["Exchange"], "H": ["Exchange", "TrafficL", "ECL"]}

# Season used when scaling errors, per report.
SEASON_OVERRIDES = {"estimation": {"Weather": 30}, "downstream": {"Weather": 1}}

LAG_FACTOR = 1.25


def _lookup(spark: SparkSession, values: dict, key: str, value: str,
            kind: str = "int") -> DataFrame:
    return small_table(spark, {key: ("string", list(values)), value: (kind, list(values.values()))})


def dataset_params(spark: SparkSession, frequencies: dict[str, str] | DataFrame | None = None,
                   horizons: dict[str, int] | None = None,
                   seasons: dict[str, int] | None = None) -> DataFrame:
    """One row per dataset: ``dataset, freq, horizon, n_lags, season``.

    ``frequencies`` are fixed by name, or a table of dataset and freq as
    ``frequency.infer_frequency`` takes it from the data. The horizon is the dataset's own
    if it has one, else the competition's for M4 names, else the default of the
    frequency. Every table here has one row per known dataset or frequency, so Spark
    broadcasts the joins by size.
    """
    names = frequencies if isinstance(frequencies, DataFrame) else _lookup(
        spark, frequencies if frequencies is not None else FREQUENCY, "dataset", "freq", "string")
    own = _lookup(spark, {**SPECIAL_HORIZON, **(horizons or {})}, "dataset", "own_h")
    own_season = _lookup(spark, seasons or {}, "dataset", "own_m")
    joined = (
        names.join(own, "dataset", "left").join(own_season, "dataset", "left")
        .join(_lookup(spark, M4_HORIZON, "freq", "m4_h"), "freq", "left")
        .join(_lookup(spark, HORIZON, "freq", "usual_h"), "freq", "left")
        .join(_lookup(spark, SEASON, "freq", "usual_m"), "freq", "left"))
    m4 = F.when(F.col("dataset").startswith("m4"), F.col("m4_h"))
    other = F.when(~F.col("dataset").startswith("m4"), F.col("usual_h"))
    return joined.withColumn("horizon", F.coalesce("own_h", m4, other)).select(
        "dataset", "freq", "horizon",
        F.floor(F.col("horizon") * F.lit(LAG_FACTOR)).cast("int").alias("n_lags"),
        F.coalesce("own_m", "usual_m").alias("season"))


def long_horizon_params(spark: SparkSession, resample_to: str | None = None) -> DataFrame:
    """Parameters of the long-horizon datasets, before or after resampling."""
    if resample_to is not None and resample_to not in RESAMPLED:
        raise ValueError(f"cannot resample to {resample_to!r}")
    chosen = {
        name: own if resample_to is None or name in KEPT_AS_IS[resample_to]
        else RESAMPLED[resample_to]
        for name, own in LONG_HORIZON.items()}
    return dataset_params(
        spark, {n: freq for n, (freq, _, _) in chosen.items()},
        {n: h for n, (_, h, _) in chosen.items()}, {n: m for n, (_, _, m) in chosen.items()})


def override_seasonality(params: DataFrame, overrides: dict[str, int]) -> DataFrame:
    """Replace the season of the named datasets."""
    table = _lookup(params.sparkSession, overrides, "dataset", "_season")
    return (params.join(table, "dataset", "left")
            .withColumn("season", F.coalesce("_season", "season")).drop("_season"))
