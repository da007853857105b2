"""Headline-query benchmark.

Runs the headline catalogue queries at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints ONE JSON line.
Each query is forced end to end with the no-op sink (full evaluation, no
collect to the driver). One untimed warm-up query primes the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from affinity.plans.catalog import REGISTRY  # noqa: E402
from affinity.session import build_session  # noqa: E402

HEADLINE = [
    "q_llr_user",        # LLR similarity (flagship)
    "q_llr_item",        # item-item LLR over the event stream
    "q_knn_exact",       # blocked exact KNN
    "q_predict_knn",     # KNN prediction
    "q_all_metrics",     # RMSE / MAP / recall
    "q_gram_predict",    # Gram baseline
    "q_lsh_cosine",      # LSH neighbours
    "q_lsh_jaccard",     # MinHash banding over purchase sets
    "q_transitions",     # node2vec transitions
    "q_walks",           # second-order walks
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="affinity-bench", shuffle_partitions=max(8, 2 * cpus))
    REGISTRY["q_counts"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
