"""Queries over sources and stored results."""

from pyspark.sql import functions as F

from panelfold.schema import ID, TARGET, TIME
from panelfold.session import shared_folder
from panelfold.sources import panels as P
from panelfold.sources import results as R

from .nestedsql import stacked_results
from .panels import table
from .sqltext import ctes
from .stored import DATASETS, listing, stored

QUERIES, SQL = {}, {}

# -- panels ---------------------------------------------------------------------

QUERIES["load_panel"] = lambda spark, sf: P.load_panel(
    table(spark, sf, "events"), "user_id", "ts", "value", min_n_instances=60, sample_n_uid=40)
SQL["load_panel"] = """
WITH big AS (SELECT CAST(user_id AS VARCHAR) AS unique_id FROM events GROUP BY 1
             HAVING count(*) >= 60),
     first AS (SELECT unique_id FROM big ORDER BY 1 LIMIT 40)
SELECT CAST(user_id AS VARCHAR) AS unique_id, ts AS ds, value AS y FROM events
WHERE CAST(user_id AS VARCHAR) IN (SELECT unique_id FROM first)"""

QUERIES["explode_nested"] = lambda spark, sf: P.explode_nested(
    table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias(ID), "embedding")
).select(ID, F.col("position").cast("long").alias("position"),
         F.col("embedding").cast("double").alias(TARGET))
SQL["explode_nested"] = """
SELECT CAST(vec_id AS VARCHAR) AS unique_id, unnest(range(len(embedding))) AS position,
       CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings"""

QUERIES["conform_columns"] = lambda spark, sf: P.conform_columns(
    table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("ts").alias("timestamp"),
        F.col("value").alias("target"), F.col("event_type").alias("category")))
SQL["conform_columns"] = """
SELECT CAST(user_id AS VARCHAR) AS unique_id, ts AS ds, value AS y FROM events"""


def _texts(spark, sf):
    """Times as text. Some purchases carry a property where the time should be."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    dirty = (F.col("event_type") == "purchase") & (F.col("value") > 50)
    return table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), "event_id",
        F.when(dirty, F.col("props")).otherwise(text).alias(TIME))


QUERIES["parse_timestamps"] = lambda spark, sf: P.parse_timestamps(
    _texts(spark, sf), TIME, "dataset")
SQL["parse_timestamps"] = """
WITH p AS (SELECT event_type AS dataset, event_id,
             CASE WHEN event_type = 'purchase' AND value > 50 THEN NULL ELSE ts END AS t FROM events)
SELECT dataset, event_id, CASE WHEN bool_or(t IS NULL) OVER (PARTITION BY dataset)
       THEN date_trunc('day', t) ELSE t END AS ds FROM p"""

QUERIES["dataset_catalog"] = lambda spark, sf: R.dataset_catalog(spark, sf)
SQL["dataset_catalog"] = """
SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
               'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations'])
       AS dataset"""

# -- stored results ---------------------------------------------------------------

COUNTS = ["seed", "dataset", "method", "stage"]


def _counts(frame):
    return frame.groupBy(*COUNTS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("yhat").alias("n_forecasts"),
        F.countDistinct(ID).alias("n_series"))


COUNTS_SQL = """SELECT seed, dataset, method, stage, count(*) AS n_rows,
  count(yhat) AS n_forecasts, count(DISTINCT unique_id) AS n_series FROM results GROUP BY ALL"""


def _write(spark, sf):
    """Copy all results into a new table and read it back."""
    path = shared_folder(spark, "copy")
    R.write_cv_results(stored(spark, sf), path)
    return _counts(R.read_cv_results(spark, path))


QUERIES["write_cv_results"] = _write
SQL["write_cv_results"] = ctes(results=stacked_results(DATASETS)) + COUNTS_SQL

QUERIES["read_cv_results"] = lambda spark, sf: _counts(
    stored(spark, sf).filter(F.col("stage") == "outer"))
SQL["read_cv_results"] = ctes(
    results=f"SELECT * FROM ({stacked_results(DATASETS)}) WHERE stage = 'outer'") + COUNTS_SQL

QUERIES["strip_model_prefix"] = lambda spark, sf: (
    stored(spark, sf)
    .withColumn("name", R.strip_model_prefix(F.col("model")))
    .groupBy("stage", "model", "name").agg(F.count(F.lit(1)).alias("n_rows")))
SQL["strip_model_prefix"] = ctes(results=stacked_results(DATASETS)) + """
SELECT stage, model, CASE WHEN starts_with(model, 'Auto') THEN substr(model, 5) ELSE model END
       AS name, count(*) AS n_rows FROM results GROUP BY ALL"""



def _listing(spark, sf):
    """Partitions of the stored results, from the listing of files."""
    return listing(spark, sf)


QUERIES["discover_seeds"] = lambda spark, sf: R.discover_seeds(_listing(spark, sf))
SQL["discover_seeds"] = ctes(results=stacked_results(DATASETS)) + """
SELECT DISTINCT seed, 'seed_' || seed AS label FROM results"""


def _half_finished(spark, sf):
    """The listing as if one method had lost its outer stage."""
    return _listing(spark, sf).filter(
        ~((F.col("method") == "KFold") & (F.col("stage") == "outer")
          & (F.col("dataset") == "user_day")))


HALF_SQL = f"""SELECT * FROM ({stacked_results(DATASETS)})
WHERE NOT (method = 'KFold' AND stage = 'outer' AND dataset = 'user_day')"""
COMPLETE_SQL = """SELECT seed, dataset, method FROM results GROUP BY ALL
HAVING count(DISTINCT stage) = 2"""

QUERIES["complete_pairs"] = lambda spark, sf: R.complete_pairs(_half_finished(spark, sf))
SQL["complete_pairs"] = ctes(results=HALF_SQL) + COMPLETE_SQL

QUERIES["pending_tasks"] = lambda spark, sf: R.pending_tasks(
    _listing(spark, sf).select("seed", "dataset", "method").distinct(),
    _half_finished(spark, sf))
SQL["pending_tasks"] = ctes(everything=stacked_results(DATASETS), results=HALF_SQL) + f"""
SELECT DISTINCT seed, dataset, method FROM everything EXCEPT ({COMPLETE_SQL})"""
