"""Seconds of the headline queries over BENCH_SF_DIR, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from linecue.plans import registry
from linecue.session import local_session

HEADLINE = [
    "align_spans", "tokenize_words", "vocabulary", "decimal_runs", "normalize_numbers", "normalize_timed_words", "snap_words", "shift_words", "refine_boundaries", "chapter_list",
    "warnings", "join_layout", "per_paragraph_spans", "caption_cues", "srt_files", "chart_sequence", "timing_documents", "line_classes", "paragraph_text_quote", "script_problems",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="12g", app="bench", shuffle_partitions=16)
    registry.QUERIES["normalize_numbers"](spark, sf_dir).limit(1).write.format("noop").mode("overwrite").save()  # starts the Python workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "median": statistics.median(took.values()), "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
