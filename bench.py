"""Time the headline queries on whole tables and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. A query's time
covers building its plan, any bounded lookups it makes on the way, and producing all its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from earmark.plans.registry import load_all  # noqa: E402
from earmark.session import build_session  # noqa: E402

HEADLINE = (
    "label_retrieval_matrix", "nearest_items", "nearest_by_distance", "nearest_by_bounds", "self_retrieval_hit_rate", "public_label_matrix",
    "zero_shot_labels", "segment_metadata_join", "gold_merge", "caption_propagation", "first_clip_per_song", "layered_override",
    "tag_union", "group_train_val_split", "stratified_public_sample", "exact_seeded_sample", "hard_pair_mining",
    "representative_events", "confusion_metrics", "tempo_majority_vote", "judged_rollup", "domain_tradeoff_table",
    "statistics_at_volume", "early_stopping", "plateau_stopping", "batch_encoding", "jsonl_manifest_scan", "incremental_ledger",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "earmark-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    queries["label_retrieval_matrix"].run(spark, folder).write.format("noop").mode("overwrite").save()  # starts JVM and Python workers
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
