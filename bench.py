"""Headline queries, timed. Prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median counts, plan building
included. Results are consumed in full by Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from signalsieve.plans.queries import all_queries

HEADLINE = (
    "shortlist_by_product",
    "shortlist_by_mode",
    "prospect_ratings",
    "evidence_ledger",
    "order_patterns",
    "event_stages",
    "product_verdicts",
    "signals_in_scope",
    "bucket_hits",
    "bucket_hits_by_join",
    "icp_matches",
    "redacted_contacts",
    "distinct_documents",
    "distinct_pages",
    "imported_reports",
    "nested_reports",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("signalsieve-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # Call sites of Column operations are for error messages and cost a stack walk each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session()
    registered = all_queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
