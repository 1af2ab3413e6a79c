"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tagweave.queries import queries
from tagweave.session import local_session

HEADLINE = [
    "min_slice_voted_price", "p3_normalize_records", "f2_rejection_rates", "a7_p9_p12_best_crop", "w1_top_crops",
    "j2_suppress_overlaps", "j5_fallback_boxes", "j1_match_boxes", "a8_e4_evaluate", "a1_field_votes", "a3_voted_records",
    "j7_p14_tile_boxes", "j8_sharpest_frame", "j10_propagate_chain", "j14_near_counts", "w6_rail_carry",
    "w9_distinct_lines", "q1_q2_lenient_payloads", "q4_f6_parse_replies", "f4_extract_fusion", "a17_o12_variant_summary",
    "t6_exact_split", "e2_recognize_tracks", "e1_recognize_labeled", "e3_fuse_observations", "j6_tracks_by_id",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    known, seconds = queries(), {}
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
