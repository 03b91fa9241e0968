"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line of seconds by query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidewright import queries as engine

NAMES = [
    "revenue_summary", "filter_and_or_not", "filter_like", "join_inner", "join_multi", "join_subquery", "join_anti", "agg_group", "agg_having", "agg_median", "agg_mode",
    "topk", "offset_limit", "topk_per_group", "keyset_page", "distinct_select", "distinct_hidden_order", "union_branches", "bag_difference", "consolidate",
    "include_array", "include_topn", "include_nested", "include_parent_filter", "fn_math", "fn_where", "cdc_latest", "cdc_apply_full", "effects_diff", "subscription_move", "live_incremental_agg",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine.QUERIES["scan_select"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in NAMES:
        began = time.perf_counter()
        engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
