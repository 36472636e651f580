"""Queries over cross-validation splits of the series of a panel."""

from pyspark.sql import functions as F

from panelfold.operators import splits

from .panels import user_raw
from .sqltext import RAW, UIDS, ctes
from . import sqltext

QUERIES, SQL = {}, {}


def _register(key, build, sql):
    QUERIES[key] = lambda spark, sf: build(user_raw(spark, sf))
    SQL[key] = ctes(panel=RAW["user_raw"], uids=UIDS) + sql


_register("split_holdout", splits.holdout, sqltext.holdout("Holdout", 0.7, 1))
_register("split_repeated_holdout", splits.repeated_holdout,
          sqltext.holdout("RepeatedHoldout", 0.7, 5))
_register("split_monte_carlo", splits.monte_carlo,
          sqltext.monte_carlo("MonteCarlo", 0.5, 0.2, 5))
_register("split_bootstrap", lambda p: splits.bootstrap(p, weights=True),
          sqltext.bootstrap("Bootstrap", 1, weights=True))
_register("split_repeated_bootstrap", splits.repeated_bootstrap,
          sqltext.bootstrap("RepeatedBootstrap", 5))
_register("split_kfold", splits.kfold, sqltext.kfold("KFold", 5))
_register("split_repeated_kfold", splits.repeated_kfold,
          sqltext.kfold("RepeatedKFold", 5, repeats=2))
_register("split_time_holdout", splits.time_holdout, sqltext.time_holdout())
_register("kfold_ablation", splits.kfold_ablation, " UNION ALL ".join(
    sqltext.kfold(f"KFold_k{k}", k, shuffle="KFold") for k in [3, 5, 7, 10, 20]))
_register("cv_registry", splits.split_all, sqltext.split_all())
_register("split_counts", lambda p: splits.split_counts(splits.split_all(p)), f"""
SELECT method, count(DISTINCT fold) AS n_splits, count(*) FILTER (WHERE role = 'train') AS n_train,
       count(*) FILTER (WHERE role = 'test') AS n_test
FROM ({sqltext.split_all()}) GROUP BY 1""")
_register("anti_complement", lambda p: splits.anti_complement(
    p, splits.holdout(p).filter(F.col("role") == "train")), f"""
SELECT unique_id FROM uids EXCEPT
SELECT unique_id FROM ({sqltext.holdout('Holdout', 0.7, 1)}) WHERE role = 'train'""")
