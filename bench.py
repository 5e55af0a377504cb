"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The session is warmed by one pass over the smallest tables, then every query is built and run in full
once (all rows and columns are computed, none are collected).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = {
    "clean": "q13_clean_prices",
    "split_adjust": "j01_split_factor",
    "panel": "p05_p06_returns_through_halts",
    "point_in_time_fields": "p13_j07_point_in_time_fields",
    "rolling_std": "w02_ts_std",
    "rolling_zscore": "w08_ts_zscore",
    "rank_of_rolling_return": "c01_rank_of_rolling_return",
    "rsi": "w16_rsi",
    "capped_weights": "b04_b07_signal_weights_capped",
    "book": "a03_a08_book_accounting",
    "momentum_backtest": "a15_momentum_backtest",
    "sweep": "t04_t05_sweep_table",
    "summary": "m19_summary",
    "rank_correlation": "m13_m14_information_coefficient",
    "walk_forward": "t10_walk_forward",
}
WARM = ("a15_momentum_backtest", "q13_clean_prices", "w16_rsi", "t10_walk_forward")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from barline.queries.catalog import QUERIES

    def run(name: str, where: str) -> float:
        begun = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - begun
        spark.catalog.clearCache()
        return took

    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in WARM:
        run(name, small if os.path.isdir(small) else sf)
    times = {label: round(run(name, sf), 3) for label, name in HEADLINE.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
