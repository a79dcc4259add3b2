"""Headline query timings.

dedup + balance + split, rule scan, interval mapping + merge, threshold
sweep, weight grid, gate grid, per-category evaluation) at $BENCH_SF_DIR on
local[$BENCH_CPUS] and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corpus_label_mix", "dedup_first", "undersample", "stratified_split", "funnel_stats", "prepare_corpus",
    "scan_rules", "detect_rules", "lexical_features",
    "map_findings", "merge_findings", "static_results",
    "threshold_sweep", "weight_grid", "gate_grid", "metrics_by_category", "roc_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("QUARRY_MASTER", f"local[{cpus}]")
    from quarry.session import get_spark
    from quarry.plans.registry import queries

    spark = get_spark(master=f"local[{cpus}]", app="quarry-bench", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    # warm-up: JVM, codegen, python workers
    qs["confusion"](spark, sf_dir).collect()
    times = {}
    rows = {}
    for name in HEADLINE:
        t0 = time.time()
        out = qs[name](spark, sf_dir)
        rows[name] = len(out.collect())
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows": rows, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
    }))


if __name__ == "__main__":
    main()
