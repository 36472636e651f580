"""Exact medians by selection, and results that only count when all their files are there."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfold.operators import medians as M
from panelfold.operators import shape
from panelfold.operators.positions import with_positions
from panelfold.schema import result_schema
from panelfold.sources.results import complete_pairs, pending_tasks, stored_partitions, write_cv_results


@pytest.mark.parametrize("buckets", [2, 3, 1024])
def test_medians_are_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(M, "BUCKETS", buckets)
    rng = np.random.default_rng(buckets)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 50 + [1.0, 9.0], "half": [1.0] * 10 + [2.0] * 10,
        "odd": list(rng.normal(0, 1, 101)), "even": list(rng.normal(5, 100, 200)), "far": [-1e308, 0.0, 1e308, 1e307],
        "steep": [10.0 ** k for k in range(-40, 41)], "close": [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0)],
        "signs": [-0.0, 0.0, -5.0, 5.0], "none": [None, float("nan")], "some": [None, 4.0, float("nan"), 8.0]}
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "g string, y double").repartition(7)
    found = {r["g"]: r["median"] for r in M.medians(frame, "g", "y").collect()}
    for g, values in groups.items():
        known = [v for v in values if v is not None and v == v]
        assert g in found
        assert found[g] is None if not known else found[g] == pytest.approx(float(np.median(known)), rel=1e-15), g
    assert M.medians(frame.limit(0), "g", "y").count() == 0


def test_robust_scales_hold_no_series(spark, daily):
    rng = np.random.default_rng(2)
    values = {f"s{i}": list(rng.normal(i, 1 + i, 60)) for i in range(4)} | {"flat": [2.0] * 60}
    rows = with_positions(daily(values), "D")
    stats = shape.scale_statistics(rows, "robust", 5)
    for r in stats.collect():
        y = np.array(values[r["unique_id"]][:-5])
        assert r["centre"] == pytest.approx(np.median(y), rel=1e-12)
        away = np.median(np.abs(y - np.median(y)))
        assert (r["width"] is None) if away == 0 else r["width"] == pytest.approx(away, rel=1e-12)
    text = stats._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in text and "collect_list" not in text


def results(spark, seed, methods=("A", "B"), n=40):
    fields = {f.name: f.dataType for f in result_schema().fields}
    made = {"seed": F.lit(seed), "dataset": F.lit("d x"), "yhat": F.rand(1)}
    rows = (spark.range(n).withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
            .withColumn("stage", F.explode(F.array(F.lit("inner"), F.lit("outer")))))
    for name, value in made.items():
        rows = rows.withColumn(name, value)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])


def pairs(spark, path):
    return sorted((r["seed"], r["method"]) for r in complete_pairs(stored_partitions(spark, path)).collect())


def test_a_lost_file_makes_a_pair_pending_again(spark, tmp_path):
    path = str(tmp_path / "results")
    assert stored_partitions(spark, path).count() == 0
    write_cv_results(results(spark, 1), path)
    write_cv_results(results(spark, 2, ("A",)), path)
    assert pairs(spark, path) == [(1, "A"), (1, "B"), (2, "A")]
    lost = glob.glob(f"{path}/seed=1/*/method=B/stage=outer/*.parquet")
    assert lost
    os.remove(lost[0])
    assert pairs(spark, path) == [(1, "A"), (2, "A")]
    tasks = spark.createDataFrame([(1, "d x", "A"), (1, "d x", "B")], "seed int, dataset string, method string")
    assert [r["method"] for r in pending_tasks(tasks, stored_partitions(spark, path)).collect()] == ["B"]
    write_cv_results(results(spark, 1, ("B",), 50), path)  # replaced: the last record counts
    assert pairs(spark, path) == [(1, "A"), (1, "B"), (2, "A")]


def test_files_without_a_record_are_not_complete(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = results(spark, 3)
    rows.write.partitionBy("seed", "dataset", "method", "stage").parquet(path)
    assert pairs(spark, path) == []
