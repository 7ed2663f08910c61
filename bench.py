"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_math", "label_finance_numeric", "label_mcq", "label_grounded", "label_all_responses",
    "stratified_split", "stratified_kfold", "scan_nested_json", "text_quality_profile",
    "logprob_stats", "mcq_letter_consistency", "pair_similarity", "semantic_entropy", "epistemic_features",
    "entity_rarity", "lexical_features", "feature_matrix", "impute_median", "feature_select",
    "auroc", "roc_curve", "arc_curve", "calibration_bins", "metrics_bundle", "threshold_sweep",
    "spearman_test", "chi_square", "pairwise_proportions", "rarity_terciles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    from riskloom.plans import catalog
    from riskloom.session import local_session

    spark = local_session("bench", cpus)

    def run(key: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("auroc")  # start the executor threads and the code cache
    queries = {k: round(statistics.median(run(k) for _ in range(repeats)), 3) for k in HEADLINE}
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
                      "queries": queries, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
