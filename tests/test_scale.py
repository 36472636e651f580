"""Replicated and skewed panels: results per series must not change."""

import time

from pyspark.sql import functions as F

from panelfold.operators import baseline, errors, shape
from panelfold.operators.positions import with_positions
from tests.compare import DATA
from workload.panels import panel

SF = f"{DATA}/sf0.01"
COPIES = 200


def _errors(rows):
    positioned = with_positions(rows, "MS")
    naive = baseline.seasonal_naive(positioned, 6, 12, 6).withColumn("model", F.lit("naive"))
    return errors.scaled_errors(errors.mae_by_series(naive),
                                errors.mase_scale(positioned, 12, "MS", 6))


def test_replicated_panel_is_linear_and_unchanged(spark):
    rows = panel(spark, SF, "brand_month").cache()
    single = {r.unique_id: r.err for r in _errors(rows).collect()}
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).withColumn(
        "unique_id", F.concat_ws("~", "unique_id", "copy")).drop("copy")
    start = time.perf_counter()
    got = _errors(many).withColumn("base", F.split_part("unique_id", F.lit("~"), F.lit(1)))
    found = got.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("err").alias("lo"),
                                    F.max("err").alias("hi")).collect()
    seconds = time.perf_counter() - start
    assert {r.base: r.lo for r in found} == {r.base: r.hi for r in found} == single
    assert {r.n for r in found} == {COPIES}
    # 400,000 rows; far below the time 200 separate runs would take.
    assert seconds < 60


def test_one_series_with_a_third_of_all_rows(spark):
    """A hot id in irregular data: counts, checks and means stay exact."""
    base = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("u"), (F.col("id") % 500).cast("string"))).alias("unique_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ds"),
        (F.col("id") % 10).cast("double").alias("y"))
    hot = base.filter("unique_id = 'hot'").count()
    assert hot == 20_000
    kept = shape.prune_short_series(base, 1000)
    assert kept.count() == hot
    positioned = with_positions(base)
    top = positioned.filter("unique_id = 'hot'").agg(
        F.max("pos").alias("m"), F.countDistinct("pos").alias("d"), F.max("n").alias("n")).first()
    assert (top.m, top.d, top.n) == (hot, hot, hot)
    bad = {r.unique_id: r.n_bad_steps for r in shape.validate_frequency(base, "S").collect()}
    assert bad["hot"] == hot - 1
    hours = shape.resample_hourly(base).filter("unique_id = 'hot'")
    assert hours.count() == 17
