"""Headline queries on the given tables; prints one JSON line.

Each query runs once to warm up and three times for the clock; the median counts. Results
go to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.catalog import QUERIES  # noqa: E402
from tidemark.catalog.frames import events  # noqa: E402
from tidemark.operators.keyed import densify  # noqa: E402
from tidemark.operators.rolling import history_levels  # noqa: E402
from tidemark.operators.series import HOURLY, over_series  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "k1_engineer_features_by_time", "k1_engineer_features", "d4_rolling_mean", "d8_targets",
    "c4_lookup_at_offset", "d10_dedup_last", "e4_describe", "e9_corr_matrix", "e12_histogram",
    "e13_regression_metrics", "i4_recompute_tail", "i5_refresh_features", "i8_mature_targets",
    "a4_read_table", "a7_upsert", "k2_horizon_long", "m3_ridge", "m6_direct_boosted", "g2_hour_difference",
]


def user_history(spark, d):
    """The full history block on one dense hourly series per user: the widest window job."""
    hourly = events(spark, d).groupBy(F.col("user_id").cast("string").alias("series_id"), "time").agg(
        F.sum("cents").alias("us_aqi"), F.max("cents").alias("pm2_5"), F.count("*").cast("double").alias("pm10"))
    dense = densify(hourly).na.fill(0.0)
    levels, back = history_levels()
    return over_series(dense, HOURLY, back, 0, levels)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: QUERIES[name] for name in HEADLINE}
    jobs["user_history"] = user_history
    seconds: dict[str, float] = {}
    for name, fn in jobs.items():
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            fn(spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
