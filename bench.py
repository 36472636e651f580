"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the
timed runs per query (median, after one warm-up run).
"""

import contextlib
import json
import os
import statistics
import sys
import time

from panelfold.operators import splits
from panelfold.session import local_session, shared_folder
from workload import registered, stored
from workload.panels import panel

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = ["time_wise_split", "resample_daily", "resample_hourly", "split_kfold", "cv_registry",
            "cv_outer", "seasonal_naive", "mase_scale", "naive_mase", "global_fit_predict",
            "dlinear_hourly_forecast"]


def experiment(spark, sf_dir):
    """A whole experiment, from the tables to stored forecasts, nothing reused."""
    stored.run_experiments(spark, sf_dir, shared_folder(spark, "bench"), ["user_day"])


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registered()

    def sink(frame):
        frame.write.format("noop").mode("overwrite").save()

    timed = {key: (lambda k=key: sink(queries[k](spark, SF_DIR))) for key in HEADLINE}
    timed["split_all_users"] = lambda: sink(splits.split_all(panel(spark, SF_DIR, "user_day")))
    timed["nested_experiment"] = lambda: experiment(spark, SF_DIR)
    # Reports read what an experiment stored; the warm-up run pays for storing it.
    timed["estimation_scores"] = lambda: sink(queries["estimation_scores"](spark, SF_DIR))
    seconds = {}
    for key, run in timed.items():
        run()
        laps = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            laps.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(laps), 3)
        print(f"{key}: {seconds[key]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    with contextlib.suppress(KeyboardInterrupt):
        main()
