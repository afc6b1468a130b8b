"""Wall time per query on a warm local session; prints one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed
runs per query, the median counts), BENCH_ALL=1 (every registered query
instead of the headline ones).  Rows go to Spark's no-op sink, so that neither
the driver nor a disk is measured.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from adtally.session import build_session, released
from checks.queries import QUERIES

HEADLINE = (
    "fact_scan",
    "summary_cpc",
    "summary_cpc_all_months",
    "summary_type",
    "detail_owner",
    "search_page",
    "page_json_records",
    "monthly_trend",
    "channel_month_totals",
    "owner_breakdown",
    "metric_shares",
    "metric_cpc_roi_cr",
    "display_format",
    "indexed_rows",
    "page_deep",
    "adjacent_duplicates",
    "dedupe_nonnull_counts",
    "unpivot_category_totals",
    "json_envelope_rows",
    "ingest_site_kpis",
    "ingest_rejects",
    "site_upsert_all_months",
    "json_envelope_campaign",
    "json_envelope_store",
    "json_values",
    "indexed_detail",
    "placement_kpis",
    "sample_exact_size",
    "metric_acos",
    "site_month_upsert",
)


def seconds(spark, name: str, root: str) -> float:
    start = time.perf_counter()
    with released():
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def scale_of(root: str) -> float | str:
    name = os.path.basename(root.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sorted(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = build_session(
        "adtally-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__sql__adaptive__coalescePartitions__initialPartitionNum=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds(spark, name, root)
        times[name] = round(statistics.median(seconds(spark, name, root) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": scale_of(root),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
