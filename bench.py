"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]. Prints one JSON line.

Each query is materialized in full by a noop write, so nothing is pruned away as a count would.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tarnscope.plans import load_all
from tarnscope.session import build_session

HEADLINE = (
    "gap_status_by_tile_month", "monthly_items_and_duplicates", "coverage_pooled", "fallback_best_item", "ranked_collection_join", "two_hop_pairing",
    "latency_by_clock", "first_complete_scene_by_month", "scenes_from_objects", "validity_by_scene_and_class", "paired_value_summary", "difference_quantiles",
    "record_summaries", "pixels_per_body", "extracted_records", "strategy_signatures", "mask_pixels_10m", "lake_shares_in_tiles", "log_io_summary",
    "block_byte_accounting", "sleep_overlap_of_attempts", "latest_revisions", "greedy_acquisition_cover", "retained_estimates",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus)
    registry = load_all()
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
