"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from markgrid.catalog.registry import load, runner  # noqa: E402
from markgrid.session import build_session  # noqa: E402

HEADLINE = """
document_trust class_reconciliation tag_cross_reference keyed_table_diff attribute_lookup tag_table match_cascade quality_checks
tag_normalise tag_cell_expansion class_normalise size_and_flow class_thresholds agreement_gate page_classification
nearest_label nearest_label_capped nearest_words distance_greedy_pairs revision_diff mark_size_pairs band_fill text_near_point labels_in_box
nms_two_pass nms_centre_window run_merge closed_rectangles
class_tag_counts takeoff_rows three_way_quantities threshold_sweep per_class_scores calibrated_confidence
row_clusters grid_schedules read_tables phrase_windows forward_fill tile_assignment thin_preserving_sample group_split
read_detections tag_inference_cascade size_waterfall stream_reliability
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    queries = load()
    spark = build_session("markgrid-bench", cpus, shuffle=2 * int(cpus) if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("OFF")
    # start-up (class loading, first code generation) is no part of any query
    runner(queries["class_counts"])(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        runner(queries[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
