"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from candlewick.queries import queries

HEADLINE = (
    "weekday_range", "resample_1h", "resample_weekly", "fn_rolling_mean", "fn_ema", "fn_rsi", "fn_adx", "fn_supertrend", "fn_sar", "fn_rank",
    "agg_grouped", "steps_three", "multi_symbol", "sort_limit", "bt_trades_stop", "bt_trades_target", "bt_fine_bars", "bt_metrics", "upsert", "annotate_events",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    known["weekday_range"](spark, sf).write.format("noop").mode("overwrite").save()  # start of the engine and of Python
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
