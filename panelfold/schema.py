"""Column names, schemas and fixed settings shared by every operator."""

from pyspark.sql import types as T

ID, TIME, TARGET = "unique_id", "ds", "y"
POS, SIZE = "pos", "n"

# Experiment defaults.
N_FOLDS = 5
SEED = 123
HOLDOUT_TRAIN = 0.7
MONTE_CARLO_TRAIN = 0.5
MONTE_CARLO_TEST = 0.2
KFOLD_REPEATS = 2
STEP_SIZE = 1
OUT_SET_MULTIPLIER = 2
N_SAMPLES = 20
OUT_SERIES_FRACTION = 0.3
KFOLD_SIZES = [3, 5, 7, 10, 20]
TIME_METHOD = "TimeHoldout"
BASELINE = "SeasonalNaive"
TUNED_PREFIX = "Auto"


def panel_schema(time_type: T.DataType | None = None) -> T.StructType:
    """Schema of a long panel; ``time_type`` is date unless given."""
    return T.StructType([
        T.StructField(ID, T.StringType()),
        T.StructField(TIME, time_type or T.DateType()),
        T.StructField(TARGET, T.DoubleType()),
    ])


def result_schema(time_type: T.DataType | None = None) -> T.StructType:
    """Schema of one stored cross-validation row (partition columns last)."""
    time_type = time_type or T.TimestampNTZType()
    return T.StructType([
        T.StructField("fold", T.IntegerType()),
        T.StructField(ID, T.StringType()),
        T.StructField("cutoff", time_type),
        T.StructField(TIME, time_type),
        T.StructField("lead", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("yhat", T.DoubleType()),
        T.StructField(TARGET, T.DoubleType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("stage", T.StringType()),
    ])
