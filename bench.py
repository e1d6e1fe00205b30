"""Runs the headline queries over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "select_cols", "where_bool", "like", "nr_filter", "update_where", "update_join", "unnest", "inner_join", "left_join", "strict_left_join", "join_agg", "sum", "median", "array_agg",
    "group_expr", "order_desc_top", "distinct", "distinct_count", "floor_mod", "string_fns", "regex", "python_fallback",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from rowsmith import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run also compiles code
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
