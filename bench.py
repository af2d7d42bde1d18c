"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans.catalogue import QUERIES

HEADLINE = [
    "summary_grouped", "summary_global", "column_stats", "descriptive_stats", "sort_multi", "page", "top_k", "subset_rows_cols", "filter_both",
    "distinct_values", "join_inner", "join_right", "join_full", "update_keyed", "concat_missing_cols", "stack_numeric", "split_duplicates", "transpose",
    "change_type_report", "detect_types", "format_fixed", "apply_edits", "delete_rows", "csv_roundtrip",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(sorted(times[1:])[1], 3)  # the median of three; the first run compiles
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
