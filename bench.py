"""Headline queries at one scale: prints one JSON line.  BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set it up."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adlattice.plans import load_all
from adlattice.plans.registry import QUERIES
from adlattice.session import build_session

HEADLINE = [
    "entry_layout_violations", "j01_upsert_status", "j03_resolve_specs", "j05_resolve_safe_zone", "a07_job_outcome", "w04_name_results",
    "f06_parse_objects", "j16_drop_product_titles", "j17_iou_match", "j18_union_candidates", "q01_validate_manifest",
    "g06_static_constraints", "g07_greedy_placement", "g10_edge_anchoring", "j23_fill_group_bboxes",
    "x03_mask_union", "x08_mask_minus", "x11_completeness", "x12_fragments", "c02_mask_score", "j08_join_scores",
    "f16_scan_terms", "f19_content_hash", "x17_pixel_stats", "k03_job_state_batch", "k07_stage_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    parts = 8 if cpus == "*" else max(int(cpus), 1)
    spark = build_session(f"local[{cpus}]", parts, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().write.format("noop").mode("overwrite").save()
    took = {}
    only = [a for a in sys.argv[1:]]
    for name in only or HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
