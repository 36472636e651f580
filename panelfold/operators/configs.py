"""Search space of the model families, sampled configurations and their selection."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exprs import hash_text, hash_uniform, small_table
from ..schema import N_SAMPLES, TUNED_PREFIX
from .errors import first_by, mae_by_series

# Parameter -> (kind, arguments). Arguments are the texts the
# chosen value will have; a literal is always its one argument.
INPUT = ("choice", ["1", "2"])
NOTHING = ("literal", ["None"])
RATE = ("loguniform", ["0.0001", "0.1"])
STEPS_RANGE = ("quniform", ["500", "1500", "100"])
STEPS_TWO = ("choice", ["500", "1000"])
STEPS_THREE = ("choice", ["500", "1000", "1500"])
PLAIN_OR_STANDARD = ("choice", ["None", "standard"])
BATCHES = ("choice", ["32", "64", "128"])
WINDOWS = ("choice", ["128", "256", "512"])
SEEDS = ("randint", ["1", "20"])


def _family(special: dict, steps: tuple, *, rate=RATE, scaler=PLAIN_OR_STANDARD,
            batches=BATCHES) -> dict:
    return {"input_size_multiplier": INPUT, "h": NOTHING, **special, "learning_rate": rate,
            "scaler_type": scaler, "max_steps": steps, "batch_size": batches,
            "windows_batch_size": WINDOWS, "loss": NOTHING, "random_seed": SEEDS}


SPACE: dict[str, dict[str, tuple[str, list[str]]]] = {
    "NHITS": _family({
        "n_pool_kernel_size": ("choice", [
            "[2, 2, 1]", "[1, 1, 1]", "[2, 2, 2]", "[4, 4, 4]", "[8, 4, 1]", "[16, 8, 1]"]),
        "n_freq_downsample": ("choice", [
            "[168, 24, 1]", "[24, 12, 1]", "[180, 60, 1]", "[60, 8, 1]", "[40, 20, 1]",
            "[1, 1, 1]"]),
    }, STEPS_RANGE),
    "PatchTST": _family({
        "hidden_size": ("choice", ["16", "32"]),
        "n_heads": ("choice", ["2", "4"]),
        "patch_len": ("choice", ["8", "12"]),
        "revin": ("choice", ["False", "True"]),
    }, STEPS_THREE),
    "MLP": _family({
        "hidden_size": ("choice", ["64", "128"]),
        "num_layers": ("randint", ["2", "3"]),
    }, STEPS_TWO),
    "KAN": _family({
        "grid_size": ("choice", ["5", "10"]),
        "spline_order": ("choice", ["2", "3"]),
        "hidden_size": ("choice", ["32", "64"]),
    }, STEPS_RANGE, scaler=("choice", ["None", "robust", "standard"])),
    "TFT": _family({
        "hidden_size": ("choice", ["32", "64"]),
        "n_head": ("choice", ["2", "4"]),
    }, STEPS_TWO, batches=("choice", ["32", "64"])),
    "NBEATS": _family({}, STEPS_TWO),
    "TiDE": _family({
        "hidden_size": ("choice", ["64", "128"]),
        "decoder_output_dim": ("choice", ["4", "8", "16"]),
        "temporal_decoder_dim": ("choice", ["16", "32", "64"]),
        "num_encoder_layers": ("choice", ["1", "2"]),
        "num_decoder_layers": ("choice", ["1", "2"]),
        "temporal_width": ("choice", ["2", "4", "8"]),
        "dropout": ("choice", ["0.0", "0.1", "0.2", "0.3"]),
        "layernorm": ("choice", ["True", "False"]),
    }, STEPS_RANGE, rate=("loguniform", ["0.00001", "0.01"])),
    "NLinear": _family({}, STEPS_RANGE),
    "DLinear": _family({"moving_avg_window": ("choice", ["11", "25"])}, STEPS_RANGE),
    "DeepNPTS": _family({
        "hidden_size": ("choice", ["16", "32"]),
        "dropout": ("uniform", ["0.0", "0.99"]),
        "n_layers": ("choice", ["1", "2"]),
    }, STEPS_RANGE),
}

# The families this library forecasts with.
LINEAR_FAMILIES = ["NLinear", "DLinear"]


def config_space(spark: SparkSession, families: list[str] | None = None) -> DataFrame:
    """Rows ``(family, param, kind, args)``."""
    rows = [(family, param, kind, args)
            for family in families or SPACE for param, (kind, args) in SPACE[family].items()]
    family, param, kind, args = (list(column) for column in zip(*rows))
    return small_table(spark, {"family": ("string", family), "param": ("string", param),
                               "kind": ("string", kind), "args": ("list", args)})


def decimal_text(value: Column, digits: int) -> Column:
    """Shortest decimal text with at most ``digits`` places, at least one."""
    text = F.regexp_replace(value.cast(f"decimal(18,{digits})").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def sample_configs(space: DataFrame, n: int = N_SAMPLES) -> DataFrame:
    """``n`` random configurations per family, one per draw 0..n-1.

    Returns ``(family, config_idx, config)`` with a map from parameter to text.
    """
    draws = space.withColumn("config_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = hash_uniform(hash_text(F.col("config_idx"), F.col("family"), F.col("param")))
    draws = draws.withColumn("u", u)

    def arg(i: int) -> Column:
        return F.get("args", F.lit(i)).try_cast("double")

    low, high, u = arg(0), arg(1), F.col("u")
    span = low + u * (high - low)
    value = (
        F.when(F.col("kind") == "choice",
               F.get("args", F.floor(u * F.size("args")).cast("int")))
        .when(F.col("kind") == "loguniform",
              decimal_text(F.exp(F.ln(low) + u * (F.ln(high) - F.ln(low))), 8))
        .when(F.col("kind") == "uniform", decimal_text(span, 8))
        .when(F.col("kind") == "quniform", decimal_text(F.rint(span / arg(2)) * arg(2), 1))
        .when(F.col("kind") == "randint", F.floor(span).cast("string"))
        .otherwise(F.get("args", F.lit(0))))
    # One map per configuration: as many entries as the family has parameters.
    entries = F.collect_list(F.struct(F.col("param"), F.col("value")))
    return (draws.withColumn("value", value).groupBy("family", "config_idx")
            .agg(F.map_from_entries(F.array_sort(entries)).alias("config")))


def expand_variants(configs: DataFrame, horizon: Column, input_size: Column) -> DataFrame:
    """Named, fixed variants: ``<family>_<i>`` with horizon and input size filled in."""
    set_here = F.create_map(F.lit("h"), horizon.cast("string"),
                            F.lit("input_size"), input_size.cast("string"))
    rest = F.map_filter("config", lambda k, _: ~k.isin(
        "h", "loss", "input_size", "input_size_multiplier"))
    plain = F.transform_values(rest, lambda k, v: F.when(
        (k == "scaler_type") & (v == "robust"), "standard").otherwise(v))
    kept_size = F.when(
        F.map_contains_key("config", F.lit("input_size")),
        F.map_filter("config", lambda k, _: k == "input_size"))
    # An input size of the configuration itself wins over the default.
    filled = F.map_concat(plain, F.map_filter(
        set_here, lambda k, _: (k == "h") | kept_size.isNull()),
        F.coalesce(kept_size, F.map_filter(set_here, lambda k, _: F.lit(False))))
    return configs.withColumn(
        "variant", F.concat_ws("_", "family", "config_idx")).withColumn("config", filled)


def effective_model(configs: DataFrame) -> DataFrame:
    """Add the ``features`` and ``scaler`` a linear configuration stands for.

    Only these parameters change a closed-form fit; training parameters such as
    the learning rate do not.
    """
    window = F.col("config")["moving_avg_window"]
    multiple = F.coalesce(F.col("config")["input_size_multiplier"], F.lit("1"))
    features = F.when(F.col("family") == "DLinear", F.concat(F.lit("trend"), window)).when(
        F.col("family") == "NLinear", F.concat(F.lit("season"), multiple))
    scaler = F.when(F.col("config")["scaler_type"] == "None", "none").otherwise("standard")
    return configs.withColumn("features", features).withColumn("scaler", scaler)


def rate_text(value: Column) -> Column:
    """A learning rate rounded to 5 places, written as Python writes it."""
    rounded = F.bround(value.cast("double"), 5)
    small = F.concat(F.rint(rounded * 1e5).cast("int").cast("string"), F.lit("e-05"))
    return F.when((rounded > 0) & (rounded < 1e-4), small).otherwise(decimal_text(rounded, 5))


def config_hash(config: Column) -> Column:
    """md5 of the configuration as JSON text with sorted keys."""
    pairs = F.transform(
        F.array_sort(F.map_entries(config)),
        lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')))
    return F.md5(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def config_scores(trials: DataFrame) -> DataFrame:
    """Losses of trials with their rounded configuration and its hash.

    Trials without a loss are left out.
    """
    rounded = F.transform_values("config", lambda k, v: F.when(
        k == "learning_rate", rate_text(v)).otherwise(v))
    return (trials.filter(F.col("loss").isNotNull())
            .withColumn("config", rounded)
            .withColumn("hash_value", config_hash(F.col("config")))
            .withColumn("model", F.concat(F.lit(TUNED_PREFIX), F.col("family"))))


def best_config_across_folds(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Per model, the configuration with the least mean loss over the folds."""
    # Losses belong to (features, scaler): averaged there once, configurations that
    # stand for the same fit tie bit for bit.
    fit = [*groups, "features", "scaler"]
    means = (scores.groupBy(*fit, "fold").agg(F.min("loss").alias("loss"))
             .groupBy(*fit).agg(F.avg("loss").alias("mean_loss")))
    firsts = scores.groupBy(*fit, "model", "family", "hash_value").agg(
        F.min(F.struct("fold", "config_idx", "features", "scaler")).alias("first"))
    return _best(firsts.join(means, fit).withColumn("key", F.col("mean_loss")), groups)


def best_config_single(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Per model, the configuration with the least loss within one run (fold)."""
    one = scores.withColumn("mean_loss", F.col("loss")).withColumn(
        "first", F.struct("fold", "config_idx", "features", "scaler"))
    return _best(one.withColumn("key", F.col("loss")), groups)


def _best(ranked: DataFrame, groups: list[str]) -> DataFrame:
    best = ranked.groupBy(*groups, "model", "family").agg(
        first_by("key", "hash_value", "first", "mean_loss").alias("best"))
    return best.select(
        *groups, "model", "family", F.col("best.mean_loss").alias("loss"),
        F.col("best.hash_value").alias("hash_value"),
        F.col("best.first.config_idx").alias("config_idx"),
        F.col("best.first.features").alias("features"),
        F.col("best.first.scaler").alias("scaler"))


def best_variant_per_family(forecasts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Per family, the variant with the least error averaged over series.

    ``model`` is a variant name; its family is the part before ``_``.
    """
    groups = groups or []
    # Sums of decimals don't depend on their order: equal variants tie exactly.
    means = mae_by_series(forecasts, groups).groupBy(*groups, "model").agg(
        F.avg(F.col("err").cast("decimal(28,12)")).cast("double").alias("err"))
    named = means.withColumn("family", F.split_part("model", F.lit("_"), F.lit(1)))
    best = named.withColumn("key", F.col("err")).groupBy(*groups, "family").agg(
        first_by("key", "model", "err").alias("best"))
    return best.select(*groups, "family", F.col("best.model").alias("model"),
                       F.col("best.err").alias("err"))
