"""Queries over configurations: losses, selection, refit and variants."""

from pyspark.sql import functions as F

from panelfold.functions.exprs import inline_rows
from panelfold.operators import configs as C
from panelfold.operators import origins
from panelfold.plans import nested_cv as N
from panelfold.plans import variants as V
from panelfold.schema import BASELINE, ID, TARGET, TIME

from . import nestedsql, shaping, sqltext
from .nestedsql import ACROSS, SEEDS, SINGLE, draws_sql, fold_steps, forecast_steps, space_sql
from .panels import panel
from .sqltext import ctes
from .stored import experiment

QUERIES, SQL = {}, {}
NAME = "brand_month"


def fitted(spark, sf, name=NAME, seeds=SEEDS):
    return N.fit_folds(panel(spark, sf, name), experiment(name, seeds))


# -- configurations for the datasets in the data ----------------------------------

ALL_FAMILIES = list(C.SPACE)


def _configs(spark, sf):
    """Every family's draws for each dataset, whose frequency, horizon and input size come
    from its times."""
    each = shaping.params_from_data(spark, sf).select("*", inline_rows([(f,) for f in ALL_FAMILIES], ["family"]))
    return each.join(C.sample_configs(C.config_space(spark)), "family")


def _entries(frame):
    """One row per parameter, so that maps compare as plain columns."""
    return frame.select("dataset", "freq", "n_lags", "family", "config_idx",
                        F.explode("config").alias("param", "value"))


QUERIES["sample_configs"] = lambda spark, sf: _entries(_configs(spark, sf))
SQL["sample_configs"] = ctes(**shaping.INFERRED, space=space_sql(ALL_FAMILIES), draws=draws_sql()) + """
SELECT dataset, freq, n_lags, family, config_idx, param, value FROM draws CROSS JOIN params"""

QUERIES["expand_variants"] = lambda spark, sf: C.expand_variants(
    _configs(spark, sf), F.col("horizon"), F.col("n_lags")).select(
    "dataset", "variant", F.explode("config").alias("param", "value"))
SQL["expand_variants"] = ctes(**shaping.INFERRED, space=space_sql(ALL_FAMILIES), draws=draws_sql()) + """
SELECT dataset, family || '_' || config_idx AS variant, param,
       CASE WHEN param = 'h' THEN CAST(horizon AS VARCHAR)
            WHEN param = 'input_size_multiplier' THEN CAST(n_lags AS VARCHAR)
            WHEN param = 'scaler_type' AND value = 'robust' THEN 'standard' ELSE value END AS value
FROM (SELECT * FROM draws CROSS JOIN params WHERE param <> 'loss')""".replace(
    "variant, param,", "variant, CASE WHEN param = 'input_size_multiplier' THEN 'input_size' "
    "ELSE param END AS param,")

# -- losses and selection ------------------------------------------------------------


def _losses(spark, sf):
    run = fitted(spark, sf)
    return run.scores.select(*N.FOLD, "features", "scaler", F.round("loss", 2).alias("loss")
                             ).distinct()


QUERIES["validation_loss"] = _losses
SQL["validation_loss"] = ctes(**fold_steps(NAME)) + """
SELECT DISTINCT seed, method, fold, features, scaler, round(loss, 2) AS loss FROM scores"""

QUERIES["config_scores"] = lambda spark, sf: fitted(spark, sf).scores.select(
    *N.FOLD, "model", "config_idx", "hash_value", F.round("loss", 2).alias("loss"))
SQL["config_scores"] = ctes(**fold_steps(NAME)) + """
SELECT seed, method, fold, model, config_idx, hash_value, round(loss, 2) AS loss FROM scores"""

QUERIES["best_config_across_folds"] = lambda spark, sf: N.best_configs(fitted(spark, sf)).select(
    *N.RUN, "model", "hash_value", "config_idx", "features", "scaler",
    F.round("loss", 2).alias("loss"))
SQL["best_config_across_folds"] = ctes(**fold_steps(NAME)) + f"""
SELECT seed, method, model, hash_value, first.config_idx AS config_idx,
       first.features AS features, first.scaler AS scaler, round(loss, 2) AS loss
FROM ({ACROSS})"""

QUERIES["best_config_single"] = lambda spark, sf: C.best_config_single(
    fitted(spark, sf).scores, N.FOLD).select(
    *N.FOLD, "model", "hash_value", "config_idx", F.round("loss", 2).alias("loss"))
SQL["best_config_single"] = ctes(**fold_steps(NAME)) + f"""
SELECT seed, method, fold, model, hash_value, config_idx, round(loss, 2) AS loss
FROM ({SINGLE})"""

# -- variants ---------------------------------------------------------------------------


def _variants(spark, sf):
    return V.run_variants(panel(spark, sf, NAME), experiment(NAME), F.lit(7))


QUERIES["best_variant_per_family"] = lambda spark, sf: V.best_variants(
    _variants(spark, sf).inner).withColumn("err", F.round("err", 2))
_steps = forecast_steps(NAME)
WINNERS = """
SELECT * FROM (
  SELECT seed, method, family, family || '_' || config_idx AS model, features, scaler,
         CAST(avg(CAST(err AS DECIMAL(28,12))) AS DOUBLE) AS err
  FROM (SELECT seed, method, fold, unique_id, features, scaler, avg(abs(y - yhat)) AS err
        FROM p_in GROUP BY ALL) JOIN models USING (features, scaler) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY seed, method, family
                           ORDER BY err, model) = 1"""
SQL["best_variant_per_family"] = ctes(**_steps, winners=WINNERS) + """
SELECT seed, method, family, model, round(err, 2) AS err FROM winners"""

QUERIES["outer_variants"] = lambda spark, sf: V.outer_variants(_variants(spark, sf)).withColumn(
    "yhat", F.round("yhat", 1)).withColumn(TARGET, F.round(TARGET, 1))
SQL["outer_variants"] = ctes(**_steps, winners=WINNERS) + """
SELECT w.seed, w.method, 'outer' AS stage, 0 AS fold, unique_id, cutoff, ds, lead, model,
       round(yhat, 1) AS yhat, round(y, 1) AS y
FROM p_out p JOIN winners w ON w.features = p.features AND w.scaler = p.scaler
UNION ALL SELECT seed, method, stage, fold, unique_id, cutoff, ds, lead, model,
       round(yhat, 1) AS yhat, round(y, 1) AS y
FROM results WHERE stage = 'outer' AND model = 'SeasonalNaive'"""

# -- forecasts of the nested experiment ---------------------------------------------------


def _rounded(frame):
    return frame.withColumn("yhat", F.round("yhat", 1)).withColumn(TARGET, F.round(TARGET, 1))


ROUNDED = "* REPLACE (round(yhat, 1) AS yhat, round(y, 1) AS y)"

QUERIES["inner_forecasts"] = lambda spark, sf: _rounded(N.inner_forecasts(fitted(spark, sf)))
SQL["inner_forecasts"] = ctes(**_steps) + f"""
SELECT {ROUNDED} FROM results WHERE stage = 'inner'"""

QUERIES["refit_final"] = lambda spark, sf: _rounded(N.refit_final(fitted(spark, sf)))
SQL["refit_final"] = ctes(**_steps) + f"""
SELECT {ROUNDED} FROM results WHERE stage = 'outer'"""


def _wide(spark, sf):
    rows = _rounded(N.inner_forecasts(fitted(spark, sf)))
    keys = [*N.FOLD, ID, "cutoff", TIME, TARGET]
    return origins.merge_model_columns(rows, ["AutoNLinear", "AutoDLinear", BASELINE], keys)


QUERIES["merge_model_columns"] = _wide
SQL["merge_model_columns"] = ctes(**_steps) + f"""
SELECT seed, method, fold, unique_id, cutoff, ds, y,
       max(yhat) FILTER (WHERE model = 'AutoNLinear') AS "AutoNLinear",
       max(yhat) FILTER (WHERE model = 'AutoDLinear') AS "AutoDLinear",
       max(yhat) FILTER (WHERE model = 'SeasonalNaive') AS "SeasonalNaive"
FROM (SELECT {ROUNDED} FROM results WHERE stage = 'inner') GROUP BY ALL"""


def _attach(spark, sf):
    """The baseline is the same in every run: one run's goes to the models of all."""
    rows = _rounded(N.refit_final(fitted(spark, sf)))
    first = (F.col("seed") == SEEDS[0]) & (F.col("method") == "KFold")
    naive = rows.filter((F.col("model") == BASELINE) & first)
    return origins.attach_baseline(
        rows.filter(F.col("model") != BASELINE), naive, BASELINE, "inner")


QUERIES["attach_baseline"] = _attach
# One pass over the forecasts: the model rows of a point see the baseline row beside them.
SQL["attach_baseline"] = ctes(**_steps, o=f"""
SELECT {ROUNDED}, max(round(yhat, 1)) FILTER (WHERE model = 'SeasonalNaive')
         OVER (PARTITION BY seed, method, unique_id, cutoff, ds) AS "SeasonalNaive"
FROM results WHERE stage = 'outer'""") + """
SELECT seed, method, stage, fold, unique_id, cutoff, ds, lead, model, yhat, y, "SeasonalNaive"
FROM o WHERE model <> 'SeasonalNaive'"""
