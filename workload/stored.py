"""Results of the experiments on the given tables, written once and then read."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelfold.operators.positions import with_positions
from panelfold.plans import nested_cv as N
from panelfold.plans.scoring import scale_tables
from panelfold.session import materialize, shared_folder
from panelfold.sources.results import only_complete, read_cv_results, stored_partitions, strip_model_prefix

from .nestedsql import SEEDS
from .panels import PANELS, panel

DATASETS = ["brand_month", "nation_month", "user_day", "type_hour"]


def experiment(name: str, seeds=SEEDS) -> N.Experiment:
    p = PANELS[name]
    return N.Experiment(p["horizon"], p["season"], p["freq"], tuple(seeds))


def run_experiments(spark: SparkSession, sf_dir: str, path: str, names=DATASETS) -> None:
    """Run and store each panel's experiment; partitions keep the panels apart.

    The panels do not depend on each other, so their jobs share the cluster.
    """
    def run(name: str) -> None:
        N.resume(panel(spark, sf_dir, name), experiment(name), name, f"{path}/{name}")

    with ThreadPoolExecutor(len(names)) as pool:
        list(pool.map(run, names))


# Written once per Spark application and set of tables.
_written: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _written:
        _written[key] = build()
    return _written[key]


def folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the experiments' results are stored."""
    def build() -> str:
        path = shared_folder(spark, "results")
        run_experiments(spark, sf_dir, path)
        return path

    return _once(spark, sf_dir, "results", build)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table: reports read what the experiments wrote."""
    path = folder(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        read_cv_results(spark, f"{path}/{name}") for name in DATASETS])


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions that are stored in full, from the listing of files and their records.

    Listed once: a task of an aggregation carries the whole plan below it, and returns the
    counters of each node, so the plans of reports must not hold the listing's.
    """
    path = folder(spark, sf_dir)

    def build() -> DataFrame:
        return materialize(reduce(DataFrame.unionByName, [
            stored_partitions(spark, f"{path}/{name}") for name in DATASETS]), "partitions")

    return _once(spark, sf_dir, "listing", build)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecasts of complete runs, with plain model names."""
    return only_complete(stored(spark, sf_dir), listing(spark, sf_dir)).withColumn("model", strip_model_prefix(F.col("model")))


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error scales of every panel; one row per series and part."""
    def build() -> DataFrame:
        tables = []
        for name in DATASETS:
            p = PANELS[name]
            rows = with_positions(panel(spark, sf_dir, name), p["freq"])
            tables.append(scale_tables(rows, name, p["season"], p["horizon"], p["freq"]))
        return materialize(reduce(DataFrame.unionByName, tables), "scales")

    return _once(spark, sf_dir, "scales", build)
