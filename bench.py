"""Times the headline queries, the best of a few runs each, and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: local threads."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tidemark.plans import registry

HEADLINES = ("latest_signals", "feature_vectors", "target_vector", "asof_financials_incl", "past_window_range_join", "index_corr_date", "upsert_last_wins", "new_rows_anti", "page_loop_early_stop", "links_from_pages", "keyword_notice", "vector_mean_pool")

#: Runs of each query, of which the best counts: the machine's speed differs from minute to minute.
REPEATS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["bars_daily"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and reads once
    took = {}
    for name in HEADLINES:
        each = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - start)
        took[name] = round(min(each), 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(os.path.normpath(sf_dir))}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
