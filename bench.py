"""Headline queries, timed warm: prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the median counts (default 3)
BENCH_QUERIES  comma-separated query names instead of the headline set, or 'all'
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "c6_snapshot_diff", "c6_payload_diff", "d10_diff_counts", "e1_latest_snapshots", "e2_latest_metadata", "e3_storage_growth",
    "d4_storage_summary", "d1_snapshot_summary", "g3_column_history", "g4_objects", "d8_effective_access",
    "k1_table_after_skip", "k1_table_after_overwrite", "e7_free_names", "a9_snapshot_assembly", "c1_attach_grants",
    "n3_storage_mssql", "n4_storage_oracle", "n11_routines_oracle", "e5_log_sequence", "c13_delete_cascade", "d5_dashboard",
    "x2_table_sheet", "b12_search_objects",
)


def main() -> None:
    from schemaledger.plans import registry
    from schemaledger.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    spark = local_session("schemaledger-bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    names = tuple(registry.QUERIES) if asked == "all" else tuple(asked.split(",")) if asked else HEADLINE

    started = time.perf_counter()
    registry.store_path(spark, sf_dir)
    setup = time.perf_counter() - started

    def run(name: str) -> float:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None, "store_setup_sec": round(setup, 3), "runs": runs, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
