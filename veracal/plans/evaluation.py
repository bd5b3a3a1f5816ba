"""One probe end to end: pending samples, scores, metrics, stored results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.keys import short_name
from ..operators.confidence import mlp_score
from ..operators.curate import labelled
from ..operators.joins import lookup, pending
from ..operators.metrics import all_metrics, metrics_by_groups
from ..sources.writers import write_results


def evaluate_probe(samples: DataFrame, done: DataFrame | None, dims: DataFrame,
                   layers: list[tuple[np.ndarray, np.ndarray]], path: str, model_name: str,
                   vec: str = "h_base", key: str = "hash_id", threshold: float = 0.5) -> DataFrame:
    """Score the labelled samples that are not done yet, store records and metrics, return the metrics."""
    todo = labelled(samples) if done is None else pending(labelled(samples), done, key=key)
    scored = mlp_score(lookup(todo, dims, key, "dataset", "unknown"), vec, layers, "c")
    records = scored.select(key, "dataset", F.col("is_correct").alias("y"), "c")
    records.write.mode("overwrite").parquet(f"{path}/scored")
    stored = samples.sparkSession.read.parquet(f"{path}/scored")
    overall = all_metrics(stored, [], threshold)
    write_results(
        stored.select(key, "dataset", F.col("y").alias("ground_truth_correctness"), F.col("c").alias("confidence_score")),
        overall, path, {"model": model_name, "threshold": threshold},
    )
    return metrics_by_groups(stored.withColumn("model", short_name(F.lit(model_name))), ["model", "dataset"], threshold)
