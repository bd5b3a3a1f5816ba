"""Reports over methods, models and seeds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from .metrics import METRICS, all_metrics
from .ordered import running

# Row order of the report tables and the metrics where less is better.
VARIANT_ORDER = ["full", "no_brier", "no_rank", "bce_only"]
NULL_ORDER = ["black", "white", "gaussian_noise", "blurred", "pixel_shuffled"]
LOWER_IS_BETTER = ["ece", "brier"]
MAIN_METRICS = ["ece", "brier", "aucpr", "auroc"]
NULL_METRICS = ["auroc", "aucpr", "ece", "brier", "accuracy", "f1"]


def to_long(wide: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """(keys.., metric, value) for the known metrics that the table has."""
    wanted = [m for m in (metrics or METRICS) if m in wide.columns]
    typed = wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in wanted])
    return typed.unpivot(keys, wanted, "metric", "value").where(F.col("value").isNotNull())


def per_model_mean(long: DataFrame, outer: list[str], inner: str = "vlm") -> DataFrame:
    """Mean over the runs of each model; a single run without a seed is its own mean."""
    return long.groupBy(*outer, inner, "metric").agg(F.avg("value").alias("value"))


def _pivoted(table: DataFrame, outer: list[str], metrics: list[str], agg) -> DataFrame:
    return table.where(F.col("metric").isin(metrics)).groupBy(*outer).pivot("metric", metrics).agg(agg)


def mean_of_means(long: DataFrame, outer: list[str], inner: str = "vlm", metrics: list[str] | None = None) -> DataFrame:
    """Mean over models of the per-model means, one column per metric."""
    return _pivoted(per_model_mean(long, outer, inner), outer, metrics or MAIN_METRICS, F.avg("value"))


def std_of_means(long: DataFrame, outer: list[str], inner: str = "vlm", metrics: list[str] | None = None) -> DataFrame:
    """Population std over models of the per-model means."""
    return _pivoted(per_model_mean(long, outer, inner), outer, metrics or MAIN_METRICS, F.stddev_pop("value"))


def pivot_metric(long: DataFrame, metric: str, row: str = "method", col: str = "vlm",
                 values: list[str] | None = None) -> DataFrame:
    """One metric with the models as columns."""
    picked = long.where(F.col("metric") == metric).groupBy(row)
    pivot = picked.pivot(col, values) if values else picked.pivot(col)
    return pivot.agg(F.avg("value"))


def null_table(long: DataFrame, vlm: str, kind: str = "null_type") -> DataFrame:
    """One model: mean over seeds per variant, one column per metric."""
    one = long.where((F.col("vlm") == vlm) & F.col("metric").isin(NULL_METRICS))
    return one.groupBy(kind).pivot("metric", NULL_METRICS).agg(F.avg("value"))


def mean_std(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample std over runs."""
    return long.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")
    )


def run_summary(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def signed_rank_p(ranks: list[tuple[int, int]], w: float) -> float:
    """Two-sided p of the signed-rank statistic ``w``, from the number of sign patterns for every sum of ranks.

    ``ranks`` holds (twice the rank, how often), so that tied ranks, which may
    be halves, are whole numbers.
    """
    counts = np.array([1.0])
    for rank, times in ranks:
        for _ in range(times):
            grown = np.zeros(len(counts) + rank)
            grown[: len(counts)] += counts
            grown[rank:] += counts
            counts = grown
    upto = int(round(2 * w)) + 1
    return float(min(1.0, 2.0 * counts[:upto].sum() / counts.sum()))


@F.pandas_udf(DoubleType())
def _exact(ranks: pd.Series, w: pd.Series) -> pd.Series:
    out = [None if r is None else signed_rank_p([(x["rank"], x["times"]) for x in r], v) for r, v in zip(ranks, w)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if pd.notna(v) else None)


def signed_rank(long: DataFrame, by: list[str], variant: str, base: str, pair: str = "seed",
                exact_max: int = 50, least: int = 5) -> DataFrame:
    """Paired signed-rank test of every variant against the base, pairs met by ``pair``.

    Zero differences are dropped and ties share their average rank. Up to
    ``exact_max`` differences the distribution over all signs is exact, ties
    included; above, the normal approximation with tie correction serves. Fewer
    than ``least`` pairs, or no difference at all, give no p-value.
    """
    keys = by + [variant]
    # the base value beside every variant of the same pair; a pair holds one row per variant
    beside = F.max(F.when(F.col(variant) == base, F.col("value"))).over(Window.partitionBy(*by, pair))
    diffs = (
        long.withColumn("_base", beside)
        .where((F.col(variant) != base) & F.col("_base").isNotNull())
        .select(*keys, (F.col("_base") - F.col("value")).alias("d"))
    )
    hist = diffs.groupBy(*keys, F.abs("d").alias("a")).agg(
        F.sum((F.col("d") > 0).cast("bigint")).alias("up"), F.sum((F.col("d") < 0).cast("bigint")).alias("down"),
        F.count("*").alias("t_all"),
    )
    moved = F.col("up") + F.col("down")
    ranked = running(hist, keys, ["a"], {"cum": ("sum", moved)})
    avg_rank = F.col("cum") - (moved - 1) / 2.0
    t = moved.cast("double")
    stats = ranked.groupBy(*keys).agg(
        F.sum("t_all").alias("n_pairs"),
        F.sum(moved).cast("int").alias("n"),
        F.sum(F.col("up") * avg_rank).alias("w_plus"),
        F.sum(F.col("down") * avg_rank).alias("w_minus"),
        F.sum(t * t * t - t).alias("ties"),
        # no more than the exact distribution takes
        F.collect_list(F.when((F.col("cum") <= exact_max) & (moved > 0), F.struct((2 * avg_rank).cast("int").alias("rank"), moved.cast("int").alias("times")))).alias("_ranks"),
    ).withColumn("w", F.least("w_plus", "w_minus"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.when(var > 0, (F.col("w") - n * (n + 1) / 4.0) / F.sqrt(F.when(var > 0, var)))
    few = (F.col("n") > 0) & (F.col("n") <= exact_max)
    both = stats.withColumns({"_approx": _two_sided(z), "_p": _exact(F.when(few, F.col("_ranks")), F.col("w"))})
    p = F.when((F.col("n_pairs") >= least) & (F.col("n") > 0), F.coalesce("_p", "_approx"))
    return both.select(*keys, "n_pairs", "n", "w", p.alias("p"))


def delta(long: DataFrame, by: list[str], variant: str, base: str) -> DataFrame:
    """Mean of each variant minus the base mean; sign turned where less is better."""
    means = long.groupBy(*by, variant, "metric").agg(F.avg("value").alias("value"))
    beside = F.max(F.when(F.col(variant) == base, F.col("value"))).over(Window.partitionBy(*by, "metric"))
    gap = F.col("value") - F.col("_base")
    return means.withColumn("_base", beside).where((F.col(variant) != base) & F.col("_base").isNotNull()).select(
        *by, variant, "metric", F.when(F.col("metric").isin(LOWER_IS_BETTER), -gap).otherwise(gap).alias("delta")
    )


def seed_ensemble(P: DataFrame, by: list[str], unit: str = "sample_id") -> DataFrame:
    """Metrics of the mean confidence over seeds."""
    pooled = P.groupBy(*by, unit).agg(F.avg("c").alias("c"), F.max("y").alias("y"))
    return all_metrics(pooled, by)


def seed_audit(long: DataFrame, by: list[str], requested: list[int]) -> DataFrame:
    """Requested, used and missing seeds per cell; seeds are deduplicated before they are listed."""
    seeds = long.select(*by, "seed").distinct().groupBy(*by).agg(F.sort_array(F.collect_list("seed")).alias("_used"))
    asked = F.array(*[F.lit(s) for s in requested])

    def text(a):
        return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")

    gone = F.array_except(asked, F.col("_used").cast("array<int>"))
    return seeds.select(
        *by, F.size("_used").alias("n_used"), text(F.col("_used")).alias("used"), text(gone).alias("missing")
    )
