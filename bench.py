"""Time the headline queries: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.

Each query runs once, after a warm-up on the smallest data, and writes all its columns to
a sink that drops them.  Its time goes to standard error as it ends; the one JSON line on
standard output follows at the end, also when a query went over ``BENCH_LIMIT`` seconds
(its jobs are cancelled and it is listed under ``over_limit``).
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import SparkSession

from panelcast.plans.catalog import QUERIES
from panelcast.session import build_session

HEADLINE = (
    "v14_evaluate",
    "m1_baseline_backtest",
    "m1_baseline_hourly_clipped",
    "b9_weeks_sweep",
    "m11_features_daily",
    "w4_rolling_quantiles_daily",
    "w4_rolling_quantiles_hourly",
    "w8_autocorrelation_daily",
    "p5_localize_dst",
    "p16_interpolate",
    "p17_interpolate_prefix",
    "j1_right_join",
    "a1_quantiles",
    "a11_boxplot_by_hour",
    "v1_build_submission",
    "v11_prepare",
    "m3_linear_quantile",
    "m7_quantile_forest",
)


def timed(spark: SparkSession, name: str, sf_dir: str, limit: float) -> tuple[float, bool]:
    """Seconds, and whether the query ended within ``limit``."""
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelAllJobs()

    timer = threading.Timer(limit, stop)
    timer.start()
    start = time.perf_counter()
    try:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception:
        if not late.is_set():
            raise
    finally:
        timer.cancel()
    return round(time.perf_counter() - start, 3), not late.is_set()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    limit = float(os.environ.get("BENCH_LIMIT", "200"))
    spark = build_session("bench", cpus)
    smallest = Path(sf_dir).parent / "sf0.001"
    if smallest.is_dir():
        QUERIES["v14_evaluate"](spark, str(smallest)).collect()
    seconds, over = {}, []
    for name in HEADLINE:
        seconds[name], ended = timed(spark, name, sf_dir, limit)
        if not ended:
            over.append(name)
        print(f"{name} {seconds[name]}{'' if ended else ' over limit'}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "over_limit": over,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
