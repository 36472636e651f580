"""Queries over stored results: errors, estimation scores, rankings and reports."""

from pyspark.sql import functions as F

from panelfold.operators import errors as E
from panelfold.operators import reports as R
from panelfold.plans import scoring as S
from panelfold.schema import ID

from .nestedsql import scored_steps
from .panels import table
from .sqltext import ctes
from .stored import DATASETS, results, scales

QUERIES, SQL = {}, {}
RUN = S.RUN
METHODS = ["Holdout", "RepeatedHoldout", "MonteCarlo", "Bootstrap", "RepeatedBootstrap", "KFold",
           "TimeHoldout"]
_steps = ctes(**scored_steps(DATASETS))
_steps_in = ctes(**scored_steps(DATASETS, inner_part="in"))


def rounded(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def model_errors(spark, sf, **options):
    return S.model_errors(results(spark, sf), scales(spark, sf), **options)


def _dev(spark, sf):
    return scales(spark, sf).filter(F.col("part") == "dev").drop("part")


def _inner(spark, sf):
    return results(spark, sf).filter(F.col("stage") == "inner")


# -- errors --------------------------------------------------------------------

def _mase(spark, sf):
    outer = results(spark, sf).filter(F.col("stage") == "outer")
    scale = scales(spark, sf).filter(F.col("part") == "in").drop("part")
    return rounded(E.outer_error(outer, scale, RUN), "err")


QUERIES["mase_by_model"] = _mase
SQL["mase_by_model"] = _steps + """
SELECT seed, dataset, method, model, round(avg(outer_err), 6) AS err FROM outer_series
WHERE model <> 'SeasonalNaive' GROUP BY ALL"""

QUERIES["collapse_folds"] = lambda spark, sf: rounded(E.collapse_folds(
    E.mae_by_series(_inner(spark, sf), [*RUN, "fold"]), RUN), "err", digits=5)
SQL["collapse_folds"] = _steps + """
SELECT seed, dataset, method, unique_id, model, round(avg(err), 5) AS err FROM folds GROUP BY ALL"""


def _composite_collapse(spark, sf):
    """The same from composite id strings, as files that keep only those have."""
    rows = _inner(spark, sf).withColumn(ID, F.concat(
        F.col(ID), F.lit("_fold"), F.col("fold").cast("string"), F.lit("_x0")))
    per_id = E.mae_by_series(rows, RUN).withColumn(ID, E.base_id(F.col(ID)))
    return rounded(E.collapse_folds(per_id, RUN), "err", digits=5)


QUERIES["collapse_composite_ids"] = _composite_collapse
SQL["collapse_composite_ids"] = SQL["collapse_folds"]

QUERIES["inner_error_pooled"] = lambda spark, sf: rounded(
    E.inner_error_pooled(_inner(spark, sf), _dev(spark, sf), RUN), "err")
SQL["inner_error_pooled"] = _steps + """
SELECT seed, dataset, method, model, round(inner_err, 6) AS err FROM errors"""

QUERIES["inner_error_by_fold"] = lambda spark, sf: rounded(
    E.inner_error_by_fold(_inner(spark, sf), _dev(spark, sf), RUN), "err")
SQL["inner_error_by_fold"] = _steps + """
SELECT seed, dataset, method, model, round(avg(err), 6) AS err FROM (
  SELECT seed, dataset, method, fold, model, avg(err / scale) AS err
  FROM folds JOIN scales USING (dataset, unique_id)
  WHERE part = 'dev' AND model <> 'SeasonalNaive' GROUP BY ALL) GROUP BY ALL"""

# -- selection and estimation -----------------------------------------------------

QUERIES["select_model"] = lambda spark, sf: R.select_model(model_errors(spark, sf), RUN).select(
    *RUN, "selected", "best")
SQL["select_model"] = _steps + "SELECT seed, dataset, method, selected, best FROM picked"

SCORE_SQL = """SELECT seed, dataset, method, round(mapee, 6) AS "MAPEE", round(mpee, 6) AS "MPEE",
  CAST(selected = best AS INTEGER) AS "Accuracy", round(selected_error - best_error, 6) AS "Regret"
FROM picked"""


def scores(spark, sf):
    return R.estimation_scores(model_errors(spark, sf), RUN)


QUERIES["estimation_scores"] = lambda spark, sf: rounded(
    scores(spark, sf), "MAPEE", "MPEE", "Regret")
SQL["estimation_scores"] = _steps + SCORE_SQL

QUERIES["serieswise_scores"] = lambda spark, sf: rounded(R.serieswise_scores(
    S.series_errors(results(spark, sf), scales(spark, sf)), RUN), "mae_all", "accuracy", "regret")
SQL["serieswise_scores"] = _steps_in + """
SELECT seed, dataset, method, round(avg(mae_all), 6) AS mae_all,
       round(avg(accuracy), 6) AS accuracy, round(avg(regret), 6) AS regret
FROM (SELECT seed, dataset, method, unique_id, avg(abs(i - o)) AS mae_all,
             CAST(arg_min(model, struct_pack(e := i, p := place)) FILTER (WHERE i IS NOT NULL)
                = arg_min(model, struct_pack(e := o, p := place)) FILTER (WHERE o IS NOT NULL)
                AS INTEGER) AS accuracy,
             arg_min(o, struct_pack(e := i, p := place)) FILTER (WHERE i IS NOT NULL) - min(o)
                AS regret
      FROM (SELECT seed, dataset, method, unique_id, inner_err AS i, outer_err AS o, model,
                   CASE model WHEN 'NLinear' THEN 6 ELSE 8 END AS place
            FROM inner_series JOIN outer_series USING (seed, dataset, method, unique_id, model)
            WHERE model <> 'SeasonalNaive') GROUP BY ALL)
GROUP BY ALL"""


def by_model(spark, sf):
    return R.estimation_by_model(model_errors(spark, sf), RUN)


VALUES = ["outer_error", "inner_error", "estimation_error", "abs_estimation_error"]
BY_MODEL_SQL = """SELECT seed, dataset, method, model, outer_err AS outer_error,
  inner_err AS inner_error, inner_err - outer_err AS estimation_error,
  abs(inner_err - outer_err) AS abs_estimation_error FROM errors"""
QUERIES["estimation_by_model"] = lambda spark, sf: rounded(by_model(spark, sf), *VALUES)
SQL["estimation_by_model"] = _steps + """
SELECT seed, dataset, method, model, round(outer_error, 6) AS outer_error,
       round(inner_error, 6) AS inner_error, round(estimation_error, 6) AS estimation_error,
       round(abs_estimation_error, 6) AS abs_estimation_error""" + f" FROM ({BY_MODEL_SQL})"


def seed_means(spark, sf):
    return R.average_over_seeds(scores(spark, sf), ["dataset", "method"],
                                ["MAPEE", "MPEE", "Accuracy", "Regret"])


MEANS_SQL = """SELECT dataset, method, avg(mapee) AS mapee, avg(mpee) AS mpee,
  avg(CAST(selected = best AS INTEGER)) AS accuracy, avg(selected_error - best_error) AS regret
FROM picked GROUP BY ALL"""
QUERIES["average_over_seeds"] = lambda spark, sf: rounded(
    seed_means(spark, sf), "MAPEE", "MPEE", "Accuracy", "Regret")
SQL["average_over_seeds"] = _steps + f"""
SELECT dataset, method, round(mapee, 6) AS "MAPEE", round(mpee, 6) AS "MPEE",
       round(accuracy, 6) AS "Accuracy", round(regret, 6) AS "Regret" FROM ({MEANS_SQL})"""


def _name_sql(column, names):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {column} {cases} ELSE {column} END"


METHOD_SQL = _name_sql("method", R.METHOD_NAMES)
QUERIES["summarize_methods"] = lambda spark, sf: R.summarize_methods(seed_means(spark, sf))
SQL["summarize_methods"] = _steps + f"""
SELECT {METHOD_SQL} AS method, round_even(avg(mapee), 3) AS "MAPEE",
       round_even(avg(mpee), 3) AS "MPEE", round_even(avg(accuracy), 3) AS "Accuracy",
       round_even(avg(regret), 3) AS "Regret",
       round_even(100 * avg(CASE WHEN mpee < 0 THEN 1.0 ELSE 0.0 END), 2) AS perc_underestimates,
       round_even(avg(mpee) FILTER (WHERE mpee < 0), 3) AS avg_under_estimate,
       round_even(avg(mpee) FILTER (WHERE mpee > 0), 3) AS avg_over_estimate
FROM ({MEANS_SQL}) GROUP BY 1"""


def model_means(spark, sf):
    return R.average_over_seeds(by_model(spark, sf), ["dataset", "method", "model"], VALUES)


MODEL_MEANS_SQL = f"""SELECT dataset, method, model, avg(outer_error) AS outer_error,
  avg(inner_error) AS inner_error, avg(estimation_error) AS estimation_error,
  avg(abs_estimation_error) AS abs_estimation_error FROM ({BY_MODEL_SQL}) GROUP BY ALL"""
QUERIES["summarize_models"] = lambda spark, sf: R.summarize_models(model_means(spark, sf))
SQL["summarize_models"] = _steps + f"""
SELECT *, CASE WHEN avg_outer_error IS NOT NULL THEN
         CAST(floor(rank() OVER (ORDER BY avg_outer_error NULLS LAST)
         + (count(*) OVER (PARTITION BY avg_outer_error) - 1) / 2.0) AS INTEGER) END AS outer_rank,
       CASE WHEN mean_abs_est_error IS NOT NULL THEN
         CAST(floor(rank() OVER (ORDER BY mean_abs_est_error DESC NULLS LAST)
         + (count(*) OVER (PARTITION BY mean_abs_est_error) - 1) / 2.0) AS INTEGER) END
         AS difficulty_rank
FROM (SELECT model, round_even(avg(outer_error), 3) AS avg_outer_error,
             round_even(avg(inner_error), 3) AS avg_inner_error,
             round_even(avg(estimation_error), 3) AS mean_est_error,
             round_even(avg(abs_estimation_error), 3) AS mean_abs_est_error,
             round_even(100 * avg(CASE WHEN estimation_error < 0 THEN 1.0 ELSE 0.0 END), 1)
               AS perc_underestimated
      FROM ({MODEL_MEANS_SQL}) GROUP BY 1)"""

QUERIES["pivot_model_method"] = lambda spark, sf: R.pivot_model_method(
    model_means(spark, sf), METHODS)
SQL["pivot_model_method"] = _steps + "SELECT model, " + ", ".join(
    f"""round_even(avg(abs_estimation_error) FILTER (WHERE method = '{m}'), 3) AS "{m}" """
    for m in METHODS) + f" FROM ({MODEL_MEANS_SQL}) GROUP BY 1"

# -- downstream accuracy ------------------------------------------------------------


def downstream(spark, sf):
    """Errors of the selected model; inner errors scaled as in this report."""
    return R.downstream_error(model_errors(spark, sf, inner_part="in"), RUN)


def downstream_means(spark, sf):
    return R.average_over_seeds(downstream(spark, sf), ["dataset", "method"],
                                ["selected_error", "best_error", "outer_regret"])


DOWN_SQL = """SELECT dataset, method, avg(selected_error) AS selected_error,
  avg(best_error) AS best_error, avg(selected_error - best_error) AS outer_regret
FROM picked GROUP BY ALL"""
QUERIES["downstream_error"] = lambda spark, sf: rounded(
    downstream(spark, sf), "selected_error", "best_error", "outer_regret")
SQL["downstream_error"] = _steps_in + """
SELECT seed, dataset, method, round(selected_error, 6) AS selected_error,
       round(best_error, 6) AS best_error, round(selected_error - best_error, 6) AS outer_regret
FROM picked"""

# Errors that agree to nine places tie: methods often select the same forecasts.
BOARD_SQL = f"""
WITH d AS (SELECT dataset, method, round(selected_error, 9) AS e FROM ({DOWN_SQL})),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY e NULLS LAST) AS lowest,
             rank() OVER (PARTITION BY dataset ORDER BY e NULLS LAST)
               + (count(*) OVER (PARTITION BY dataset, e) - 1) / 2.0 AS rank
      FROM d WHERE e IS NOT NULL)
SELECT dataset, method, e AS value FROM d
UNION ALL SELECT 'Avg. Rank', d.method, avg(rank) FROM d LEFT JOIN r USING (dataset, method) GROUP BY 2
UNION ALL SELECT 'Avg', method, avg(e) FROM d GROUP BY 2
UNION ALL SELECT 'Top 2 Count', d.method, CAST(count(*) FILTER (WHERE lowest < 3) AS DOUBLE)
          FROM d LEFT JOIN r USING (dataset, method) GROUP BY 2"""


def board(spark, sf):
    return R.method_leaderboard(rounded(downstream_means(spark, sf), "selected_error", digits=9))


QUERIES["method_leaderboard"] = lambda spark, sf: R.leaderboard_table(
    R.round_report(board(spark, sf), ["value"], 6), METHODS)
SQL["method_leaderboard"] = _steps_in + f"""
SELECT {_name_sql('dataset', R.DATASET_NAMES)} AS dataset, """ + ", ".join(
    f"""max(round_even(value, 6)) FILTER (WHERE method = '{m}') AS "{R.METHOD_NAMES.get(m, m)}" """
    for m in METHODS) + f" FROM ({BOARD_SQL}) GROUP BY ALL"

QUERIES["annotate_top2"] = lambda spark, sf: R.annotate_top2(board(spark, sf))
SQL["annotate_top2"] = _steps_in + f"""
SELECT dataset, method, value, CASE WHEN value IS NOT NULL THEN
         CASE dense_rank() OVER (PARTITION BY dataset ORDER BY value NULLS LAST)
         WHEN 1 THEN 'best' WHEN 2 THEN 'second' END END AS mark
FROM (SELECT dataset, method, round_even(value, 3) AS value FROM ({BOARD_SQL}))"""


def outer_means(spark, sf):
    means = R.average_over_seeds(by_model(spark, sf), ["dataset", "method", "model"],
                                 ["outer_error"])
    return means.withColumn("outer", F.round("outer_error", 9)).drop("outer_error")


OUTER_SQL = f"""SELECT dataset, method, model, round(outer_error, 9) AS o
FROM ({MODEL_MEANS_SQL})"""
QUERIES["rank_methods"] = lambda spark, sf: rounded(
    R.rank_methods(outer_means(spark, sf)), "avg_rank")
SQL["rank_methods"] = _steps + f"""
SELECT method, round(avg(r), 6) AS avg_rank FROM (
  SELECT method, model, avg(r) AS r FROM (
    SELECT *, rank() OVER (PARTITION BY dataset, model ORDER BY o NULLS LAST) AS r
    FROM ({OUTER_SQL}) WHERE o IS NOT NULL)
  GROUP BY ALL) GROUP BY 1"""

QUERIES["rank_models"] = lambda spark, sf: rounded(
    R.rank_models(outer_means(spark, sf)), "avg_rank")
SQL["rank_models"] = _steps + f"""
SELECT model, round(avg(r), 6) AS avg_rank FROM (
  SELECT method, model, avg(r) AS r FROM (
    SELECT *, rank() OVER (PARTITION BY dataset, method ORDER BY o NULLS LAST) AS r
    FROM ({OUTER_SQL}) WHERE o IS NOT NULL)
  GROUP BY ALL) GROUP BY 1"""

QUERIES["label_names"] = lambda spark, sf: results(spark, sf).select("dataset", "method").groupBy(
    "dataset", "method").agg(F.count(F.lit(1)).alias("n_rows")).select(
    R.label(F.col("dataset"), R.DATASET_NAMES).alias("dataset"),
    R.label(F.col("method"), R.METHOD_NAMES).alias("method"), "n_rows")
SQL["label_names"] = _steps + f"""
SELECT dataset, {METHOD_SQL} AS method, count(*) AS n_rows FROM named GROUP BY ALL"""

QUERIES["round_report"] = lambda spark, sf: R.round_report(
    model_means(spark, sf), VALUES)
SQL["round_report"] = _steps + f"""
SELECT dataset, method, model, round_even(outer_error, 3) AS outer_error,
       round_even(inner_error, 3) AS inner_error,
       round_even(estimation_error, 3) AS estimation_error,
       round_even(abs_estimation_error, 3) AS abs_estimation_error FROM ({MODEL_MEANS_SQL})"""

# -- repeated measurements ------------------------------------------------------------


def _runs(spark, sf):
    """Seconds past the minute per event type and weekday: the shape of a table of runs."""
    return table(spark, sf, "events").select(
        "event_type", F.dayofweek("ts").alias("day"),
        F.extract(F.lit("SECOND"), "ts").cast("double").alias("seconds"))


RUNS_SQL = """SELECT event_type, CAST(dayofweek(ts) + 1 AS INTEGER) AS day,
  (epoch_us(ts) % 60000000) / CAST(1000000 AS DOUBLE) AS seconds FROM events"""
KEYS = ["event_type", "day"]
SUMMARY_SQL = f"""SELECT event_type, day, count(*) AS runs, round_even(avg(seconds), 2) AS mean,
  round_even(stddev_pop(seconds), 2) AS std, min(seconds) AS min, max(seconds) AS max
FROM ({RUNS_SQL}) GROUP BY ALL"""

QUERIES["timing_summary"] = lambda spark, sf: R.timing_summary(_runs(spark, sf), KEYS)
SQL["timing_summary"] = SUMMARY_SQL
QUERIES["timing_grid"] = lambda spark, sf: R.timing_grid(
    R.timing_summary(_runs(spark, sf), KEYS), "event_type", "day", list(range(1, 8)))
SQL["timing_grid"] = "SELECT event_type, " + ", ".join(
    f'max(mean) FILTER (WHERE day = {d}) AS "{d}"' for d in range(1, 8)
) + f" FROM ({SUMMARY_SQL}) GROUP BY 1"
QUERIES["timing_extremes"] = lambda spark, sf: R.timing_extremes(
    R.timing_summary(_runs(spark, sf), KEYS), KEYS)
SQL["timing_extremes"] = f"""
WITH s AS ({SUMMARY_SQL}), f AS (SELECT * FROM s ORDER BY mean, event_type, day LIMIT 1),
     w AS (SELECT * FROM s ORDER BY mean DESC, event_type DESC, day DESC LIMIT 1)
SELECT f.event_type AS fastest_event_type, f.day AS fastest_day,
       w.event_type AS slowest_event_type, w.day AS slowest_day,
       f.mean AS fastest, w.mean AS slowest, round_even(w.mean / nullif(f.mean, 0), 2) AS speedup,
       round_even((w.mean - f.mean) / nullif(w.mean, 0) * 100, 1) AS perc_saved FROM f, w"""
