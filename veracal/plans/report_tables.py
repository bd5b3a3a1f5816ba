"""Report tables, from result files or straight from predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import percent
from ..operators.curate import display_order
from ..operators.metrics import all_metrics
from ..operators.report import (
    MAIN_METRICS, NULL_METRICS, NULL_ORDER, VARIANT_ORDER, delta, mean_of_means, mean_std, null_table,
    pivot_metric, signed_rank, to_long,
)

RUN_KEYS = ["method", "vlm", "seed"]


def long_metrics(P: DataFrame) -> DataFrame:
    """(method, vlm, seed, metric, value) computed from (confidence, label) pairs."""
    return to_long(all_metrics(P, RUN_KEYS), RUN_KEYS)


def main_table(long: DataFrame, methods: list[str]) -> DataFrame:
    """Mean of means per method in display order, as percent texts."""
    table = display_order(mean_of_means(long, ["method"]), "method", methods)
    return table.select("method", "position", *[percent(F.col(m)).alias(m) for m in MAIN_METRICS])


def variant_table(long: DataFrame) -> DataFrame:
    table = display_order(mean_of_means(long, ["variant"]), "variant", VARIANT_ORDER).where("position > 0")
    return table.select("variant", "position", *[percent(F.col(m)).alias(m) for m in MAIN_METRICS])


def null_view_table(long: DataFrame, vlm: str) -> DataFrame:
    table = display_order(null_table(long, vlm), "null_type", NULL_ORDER).where("position > 0")
    return table.select("null_type", "position", *[percent(F.col(m)).alias(m) for m in NULL_METRICS])


def per_model_table(long: DataFrame, metric: str, vlms: list[str]) -> DataFrame:
    table = pivot_metric(long, metric, values=vlms)
    return table.select("method", *[percent(F.col(v)).alias(v) for v in vlms])


def null_comparison(long: DataFrame, base: str = "black") -> DataFrame:
    """Per variant and metric: mean, std, signed-rank p against the base, and the turned difference."""
    spread = mean_std(long, ["null_type", "metric"])
    p = signed_rank(long, ["metric"], "null_type", base).select("null_type", "metric", "p")
    gap = delta(long, [], "null_type", base)
    return spread.join(p, ["null_type", "metric"], "left").join(gap, ["null_type", "metric"], "left")
