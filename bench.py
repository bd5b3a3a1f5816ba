"""Time the headline queries and print one JSON line.

Every query runs twice; ``queries`` and ``value`` hold the second run, ``first``
the run that still compiles code.
"""

from __future__ import annotations

import json
import os
import time

from veracal.catalog import load
from veracal.session import build_session

HEADLINE = [
    "m00_all_metrics", "m01_ece", "m02_reliability_curve", "m07_auroc", "m08_aucpr", "m12_metrics_by_groups",
    "m14_youden", "a03_mean_of_means", "a09_signed_rank", "a11_seed_ensemble",
    "c02_content_key", "u04_dedup_first", "u06_stratified_exact", "q04_contract_check", "q05_word_summary", "q08_runs",
    "j01_items_with_outputs", "j04_lookup_default", "j11_common_samples", "j12_random_partner",
    "x01_verbal_confidence", "x03_two_stage_confidence", "v04_prompt_ensemble", "v06_probe_score_hidden",
    "v12_logit_stats", "v21_token_features", "v27_attention_mean", "t01_sequences",
    "l04_loss_variants", "l09_early_stop_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    # start the workers and load the classes every query needs
    queries["m00_all_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["v06_probe_score_hidden"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    first, seconds = {}, {}
    for times in (first, seconds):
        for name in HEADLINE:
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first": first, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
