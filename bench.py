"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query runs once to warm up, then the better of two runs
counts; results go to Spark's no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import re
import time

from hazardlens.plans.catalog import QUERIES
from hazardlens.session import build_session

HEADLINE = [
    "enrich_earthquakes", "enrich_weather", "enrich_air_quality", "enrich_wildfires",
    "anomaly_events", "quality_funnel", "source_activity",
    "events_per_hour", "risk_distribution_by_source", "dashboard_summary",
    "quake_daily_trend", "fire_grid_hotspots", "last_k_per_location",
    "events_within_radius", "unified_risk", "regional_rankings",
    "alert_rows", "forecast_additive", "paginated_query",
    "stream_etl_weather", "stream_events_per_hour", "stream_dedup",
]


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, sf_dir, name)
        seconds[name] = round(min(timed(spark, sf_dir, name) for _ in range(2)), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
