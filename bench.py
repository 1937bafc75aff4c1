"""Headline queries on the catalogue; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from temblor.session import session  # noqa: E402

HEADLINE = ["filter_dashboard", "enrich", "daily_counts", "inter_event_stats", "magnitude_histogram", "stratified_sample", "gr_fit", "gr_rolling", "decay_grid_fit", "dbscan", "st_dbscan", "gardner_knopoff", "srl_mainshocks", "step_magnitude", "reasenberg"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir="/tmp/temblor-warehouse", spark__checkpoint__dir="file:///tmp/temblor-scratch")
    spark.sparkContext.setLogLevel("OFF")
    from temblor.plans.catalogue_queries import QUERIES

    QUERIES["summary_stats"](spark, sf_dir).collect()  # starts the session's machinery
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "catalogue_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
