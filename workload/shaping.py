"""Queries over panel shaping: filters, samples, time splits, resampling, scaling."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelfold.operators import shape
from panelfold.operators.errors import mase_scale_by_season
from panelfold.operators.positions import with_positions
from panelfold.schema import ID, TARGET, TIME
from panelfold.sources.frequency import infer_frequency
from panelfold.sources.params import (HORIZON, M4_HORIZON, SEASON, SEASON_OVERRIDES, dataset_params,
                                      override_seasonality)

from .panels import BUILDERS, PANELS, panel, stacked, table, user_raw
from .sqltext import PANEL, POSITIONS, RAW, UIDS, ctes, resampled, sampled
from . import sqltext

QUERIES, SQL = {}, {}


def _freq(name):
    return PANELS[name]["freq"]


# -- filters and samples ------------------------------------------------------

QUERIES["prune_short_series"] = lambda spark, sf: shape.prune_short_series(user_raw(spark, sf), 66)
SQL["prune_short_series"] = ctes(panel=RAW["user_raw"]) + """
SELECT unique_id, ds, y FROM panel
WHERE unique_id IN (SELECT unique_id FROM panel GROUP BY 1 HAVING count(*) >= 66)"""

QUERIES["sample_first_uids"] = lambda spark, sf: shape.sample_first_uids(user_raw(spark, sf), 10)
SQL["sample_first_uids"] = ctes(panel=RAW["user_raw"]) + """
SELECT unique_id, ds, y FROM panel
WHERE unique_id IN (SELECT DISTINCT unique_id FROM panel ORDER BY 1 LIMIT 10)"""

QUERIES["sample_uids"] = lambda spark, sf: shape.sample_uids(user_raw(spark, sf), 0.7)
SQL["sample_uids"] = ctes(panel=RAW["user_raw"], uids=UIDS) + f"""
SELECT unique_id, ds, y FROM panel WHERE unique_id IN ({sampled('0.7')})"""


def _filter_uids(spark, sf):
    from panelfold.operators.splits import holdout
    rows = panel(spark, sf, "user_day")
    return shape.filter_series(rows, holdout(rows).filter(F.col("role") == "test"))


QUERIES["filter_uids"] = _filter_uids
SQL["filter_uids"] = ctes(panel=PANEL["user_day"], uids=UIDS) + f"""
SELECT unique_id, ds, y FROM panel WHERE unique_id IN (
  SELECT unique_id FROM ({sqltext.holdout('Holdout', 0.7, 1)}) WHERE role = 'test')"""

# -- values within a series ---------------------------------------------------

QUERIES["dummify_series"] = lambda spark, sf: shape.dummify_series(
    panel(spark, sf, "type_hour"), _freq("type_hour"))
SQL["dummify_series"] = ctes(panel=PANEL["type_hour"]) + """
SELECT unique_id, ds, CAST(row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS DOUBLE) AS y
FROM panel"""

QUERIES["difference_series"] = lambda spark, sf: shape.difference_series(
    panel(spark, sf, "user_day"), _freq("user_day")).withColumn(TARGET, F.round(TARGET, 6))
SQL["difference_series"] = ctes(panel=PANEL["user_day"], pos=POSITIONS) + """
SELECT unique_id, ds, y FROM (
  SELECT unique_id, ds, pos, round(y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds), 6) AS y
  FROM pos) WHERE pos > 1"""

QUERIES["uid_tails"] = lambda spark, sf: shape.uid_tails(
    panel(spark, sf, "type_hour"), 30, _freq("type_hour"))
SQL["uid_tails"] = ctes(panel=PANEL["type_hour"], pos=POSITIONS) + """
SELECT unique_id, ds, y FROM pos WHERE pos > n - 30"""

# -- splits in time -----------------------------------------------------------

QUERIES["time_wise_split"] = lambda spark, sf: shape.label_time_split(
    panel(spark, sf, "brand_month"), 6, _freq("brand_month"))
SQL["time_wise_split"] = ctes(panel=PANEL["brand_month"], pos=POSITIONS) + """
SELECT unique_id, ds, y, CASE WHEN pos > n - 6 THEN 'test' ELSE 'train' END AS part FROM pos"""

QUERIES["nested_time_split"] = lambda spark, sf: shape.nested_time_split(
    panel(spark, sf, "type_hour"), 12, _freq("type_hour"))
SQL["nested_time_split"] = ctes(panel=PANEL["type_hour"], pos=POSITIONS) + """
SELECT unique_id, ds, y, CASE WHEN pos > n - 24 THEN 'out' WHEN pos > n - 36 THEN 'in'
                              ELSE 'dev' END AS part FROM pos"""


def _concat(spark, sf):
    train, test = shape.time_wise_split(panel(spark, sf, "user_day"), 3, _freq("user_day"))
    return shape.concat_time_wise(train, test).orderBy(ID, TIME)


QUERIES["concat_time_wise"] = _concat
SQL["concat_time_wise"] = ctes(panel=PANEL["user_day"]) + """
SELECT unique_id, ds, y FROM panel ORDER BY 1, 2"""

QUERIES["outset_series_holdout"] = lambda spark, sf: shape.outset_series_holdout(
    panel(spark, sf, "user_day"), 3, _freq("user_day"))
SQL["outset_series_holdout"] = ctes(panel=PANEL["user_day"], pos=POSITIONS, uids=UIDS) + f"""
SELECT unique_id, ds, y,
       CASE WHEN pos > n - 6 THEN 'out' WHEN pos > n - 9 THEN 'in' ELSE 'dev' END AS part,
       pos <= n - 6 AND unique_id IN ({sampled('1 - 0.3')}) AS in_set
FROM pos"""

# -- resampling ---------------------------------------------------------------

QUERIES["resample_daily"] = lambda spark, sf: panel(spark, sf, "user_day")
SQL["resample_daily"] = resampled(RAW["user_raw"], "day")

QUERIES["resample_hourly"] = lambda spark, sf: panel(spark, sf, "type_hour")
SQL["resample_hourly"] = resampled(RAW["type_raw"], "hour")

# -- checks and summaries -----------------------------------------------------

QUERIES["validate_frequency"] = lambda spark, sf: shape.validate_frequency(
    table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias(ID), F.to_date("ts").alias(TIME)), "D")
SQL["validate_frequency"] = """
SELECT unique_id, n_rows, n_bad_steps FROM (
  SELECT unique_id, count(*) AS n_rows,
         count(*) FILTER (WHERE nxt IS NOT NULL AND nxt <> ds + 1) AS n_bad_steps
  FROM (SELECT unique_id, ds, lead(ds) OVER (PARTITION BY unique_id ORDER BY ds) AS nxt
        FROM (SELECT CAST(user_id AS VARCHAR) AS unique_id, CAST(ts AS DATE) AS ds FROM events))
  GROUP BY 1) WHERE n_bad_steps > 0"""

QUERIES["min_size_check"] = lambda spark, sf: shape.min_size_check(user_raw(spark, sf), 30, 30)
SQL["min_size_check"] = ctes(panel=RAW["user_raw"]) + """
SELECT unique_id, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) < 60"""

NAMES = list(BUILDERS)
PARAMS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, '{p['freq']}' AS freq, CAST({p['horizon']} AS INTEGER) AS horizon,"
    f" CAST(floor({p['horizon']} * 1.25) AS INTEGER) AS n_lags, CAST({p['season']} AS INTEGER) AS season"
    for n, p in PANELS.items())


def params(spark):
    return dataset_params(spark, {n: p["freq"] for n, p in PANELS.items()},
                          horizons={n: p["horizon"] for n, p in PANELS.items()},
                          seasons={n: p["season"] for n, p in PANELS.items()})


QUERIES["panel_summary"] = lambda spark, sf: shape.panel_summary(
    stacked(spark, sf, NAMES), params(spark))
SQL["panel_summary"] = ctes(panels=sqltext.stacked(NAMES), params=PARAMS_SQL) + """
SELECT dataset, horizon, n_lags AS input_size, count(*) AS n_obs,
       count(DISTINCT unique_id) AS n_series
FROM panels JOIN params USING (dataset) GROUP BY 1, 2, 3"""


# Panels under the names by which parameters are looked up: one with a horizon of its own, one by
# the competition's name, two with the defaults of their frequency.
LOOKED_UP = {"brand_month": "brand_month", "m4_daily": "user_day", "nation_month": "nation_month",
             "type_hour": "type_hour"}
OWN_HORIZONS = {"brand_month": PANELS["brand_month"]["horizon"]}
SHORT_SEASONS = {"m4_daily": 7, **SEASON_OVERRIDES["estimation"]}


def _looked_up(spark, sf):
    return reduce(DataFrame.unionByName, [
        panel(spark, sf, name).select(F.lit(called).alias("dataset"), ID, F.col(TIME).cast("timestamp_ntz").alias(TIME),
                                      TARGET) for called, name in LOOKED_UP.items()])


def _params_of(panels):
    return dataset_params(panels.sparkSession, infer_frequency(panels), OWN_HORIZONS)


def params_from_data(spark, sf):
    """Parameters of every panel, by the frequency that its times have."""
    return _params_of(_looked_up(spark, sf))


def _scales(spark, sf):
    """Parameters with the shorter season, and what that season makes of the error scales."""
    panels = _looked_up(spark, sf)
    params = override_seasonality(_params_of(panels), SHORT_SEASONS)
    series = F.concat_ws("|", "dataset", ID)
    rows = panels.join(params.select("dataset", "season"), "dataset").withColumn("series", series)
    scales = mase_scale_by_season(with_positions(rows, None, "series"), "series")
    named = scales.withColumn("dataset", F.substring_index("series", "|", 1))
    means = named.groupBy("dataset").agg(F.count("scale").alias("n_scales"),
                                         F.round(F.avg("scale"), 4).alias("mean_scale"))
    return params.join(means, "dataset", "left")


LOOKED_UP_SQL = " UNION ALL ".join(
    f"SELECT '{called}' AS dataset, unique_id, CAST(ds AS TIMESTAMP) AS ds, y FROM ({sqltext.PANEL[name]})"
    for called, name in LOOKED_UP.items())
INFERRED = {
    "panels": LOOKED_UP_SQL,
    "steps": """
SELECT dataset, ds, later, datediff('month', ds, later) AS months,
       ds::TIME = later::TIME AND (day(ds) = day(later)
         OR (last_day(ds) = ds::DATE AND last_day(later) = later::DATE)) AS same
FROM (SELECT *, lead(ds) OVER (PARTITION BY dataset, unique_id ORDER BY ds) AS later
      FROM (SELECT DISTINCT dataset, unique_id, ds FROM panels WHERE ds IS NOT NULL)) WHERE later IS NOT NULL""",
    "counted": """
SELECT dataset, months > 0 AND same AS monthly,
       CASE WHEN months > 0 AND same THEN months ELSE datediff('second', ds, later) END AS k, count(*) AS times
FROM steps GROUP BY ALL""",
    "best": """
SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY times DESC,
  CASE WHEN monthly THEN 2629746 * k ELSE k END) = 1""",
    "coded": """
SELECT dataset, CASE WHEN monthly THEN CASE
         WHEN k % 12 = 0 THEN CASE WHEN k = 12 THEN '' ELSE (k // 12)::VARCHAR END || 'Y'
         WHEN k % 3 = 0 THEN CASE WHEN k = 3 THEN '' ELSE (k // 3)::VARCHAR END || 'Q'
         ELSE CASE WHEN k = 1 THEN '' ELSE k::VARCHAR END || CASE WHEN starts THEN 'MS' WHEN ends THEN 'ME' ELSE 'M' END END
       WHEN k % 604800 = 0 THEN CASE WHEN k = 604800 THEN '' ELSE (k // 604800)::VARCHAR END || 'W'
       WHEN k % 86400 = 0 THEN CASE WHEN k = 86400 THEN '' ELSE (k // 86400)::VARCHAR END || 'D'
       WHEN k % 3600 = 0 THEN CASE WHEN k = 3600 THEN '' ELSE (k // 3600)::VARCHAR END || 'H'
       WHEN k % 60 = 0 THEN CASE WHEN k = 60 THEN '' ELSE (k // 60)::VARCHAR END || 'T'
       ELSE CASE WHEN k = 1 THEN '' ELSE k::VARCHAR END || 'S' END AS freq
FROM (SELECT dataset, bool_and(day(ds) = 1) AS starts, bool_and(last_day(ds) = ds::DATE) AS ends
      FROM panels GROUP BY 1) LEFT JOIN best USING (dataset)""",
    "params": f"""
SELECT dataset, freq, horizon::INTEGER AS horizon, floor(horizon * 1.25)::INTEGER AS n_lags, season::INTEGER AS season
FROM (SELECT *, CASE WHEN dataset = 'brand_month' THEN {OWN_HORIZONS['brand_month']}
                     WHEN dataset LIKE 'm4%' THEN map({list(M4_HORIZON)}, {list(M4_HORIZON.values())})[freq]
                     ELSE map({list(HORIZON)}, {list(HORIZON.values())})[freq] END AS horizon,
             map({list(SEASON)}, {list(SEASON.values())})[freq] AS season FROM coded)"""}

QUERIES["dataset_params"] = params_from_data
SQL["dataset_params"] = ctes(**INFERRED) + "SELECT dataset, freq, horizon, n_lags, season FROM params"

QUERIES["infer_frequency"] = lambda spark, sf: infer_frequency(_looked_up(spark, sf))
SQL["infer_frequency"] = ctes(**{k: v for k, v in INFERRED.items() if k != "params"}) + "SELECT dataset, freq FROM coded"

QUERIES["override_seasonality"] = _scales
SQL["override_seasonality"] = ctes(**INFERRED, changed=f"""
SELECT * REPLACE (coalesce(map({list(SHORT_SEASONS)}, {list(SHORT_SEASONS.values())})[dataset], season)::INTEGER AS season)
FROM params""", scales="""
SELECT dataset, unique_id, nullif(avg(abs(y - back)), 0) AS scale FROM (
  SELECT dataset, unique_id, y, lag(y, season) OVER (PARTITION BY dataset, unique_id ORDER BY ds) AS back
  FROM panels JOIN changed USING (dataset)) GROUP BY 1, 2""", means="""
SELECT dataset, count(scale) AS n_scales, round(avg(scale), 4) AS mean_scale FROM scales GROUP BY 1""") + """
SELECT dataset, freq, horizon, n_lags, season, n_scales, mean_scale FROM changed LEFT JOIN means USING (dataset)"""

# -- scaling ------------------------------------------------------------------


def _scale(kind, name):
    def run(spark, sf):
        rows = with_positions(panel(spark, sf, name), _freq(name))
        stats = shape.scale_statistics(rows, kind, holdout=6)
        scaled = shape.scale_series(rows, stats)
        return scaled.select(ID, TIME, F.round("scaled", 6).alias("scaled"),
                             F.round(shape.unscale(F.col("scaled")), 4).alias("restored"))
    return run


QUERIES["scale_series"] = _scale("standard", "brand_month")
SQL["scale_series"] = ctes(panel=PANEL["brand_month"], pos=POSITIONS, stats="""
  SELECT unique_id, avg(y) AS c, nullif(stddev_pop(y), 0) AS w FROM pos WHERE pos <= n - 6
  GROUP BY 1""") + """
SELECT unique_id, ds, round((y - c) / w, 6) AS scaled, round((y - c) / w * w + c, 4) AS restored
FROM pos JOIN stats USING (unique_id)"""

for _key, _name in (("scale_series_robust", "user_day"), ("scale_series_robust_hourly", "type_hour")):
    QUERIES[_key] = _scale("robust", _name)
    SQL[_key] = ctes(panel=PANEL[_name], pos=POSITIONS, centre="""
  SELECT unique_id, median(y) AS c FROM pos WHERE pos <= n - 6 GROUP BY 1""", stats="""
  SELECT unique_id, any_value(c) AS c, nullif(median(abs(y - c)), 0) AS w
  FROM pos JOIN centre USING (unique_id) WHERE pos <= n - 6 GROUP BY 1""") + """
SELECT unique_id, ds, round((y - c) / w, 6) AS scaled, round((y - c) / w * w + c, 4) AS restored
FROM pos JOIN stats USING (unique_id)"""
