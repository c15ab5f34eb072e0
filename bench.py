"""Time the headline queries end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from earwitness import catalog
from earwitness.session import build_session

HEADLINE = (
    "status_counts", "representative", "align_regions", "chunk_reconcile", "overlap_dedup", "full_transcript", "srt_cues",
    "speaker_turns", "speaker_overlap_join", "merged_duration", "review_summary", "corrections_applied", "scorecards",
    "pilot_summary", "pilot_rollup", "chain_verify", "cumulative_spend_stop", "cost_preflight", "execution_plan", "price_quotes",
    "chunk_plan_fixed", "chunk_plan_silence", "object_retention", "archive_folders", "job_inbox", "native_timing", "signal_structure",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "earwitness-bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    if names == ["all"]:
        names = list(queries)
    queries["job_inbox"](spark, sf_dir).collect()  # start the JVM's code paths and the file cache
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
