"""Calibration and discrimination metrics for any grouping of (confidence, label) pairs.

Input is a table with a label column ``y`` (0 / 1) and a confidence column ``c``.
Every metric starts from one histogram of distinct scores per group, which
combines on the map side; ranking metrics then run over blocks of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binning import edge, grid_index, lower_closed_bin, upper_closed_bin
from .joins import lookup
from .ordered import GROUP, group_key, running

# Metric names in report order.
METRICS = [
    "ece", "brier", "aucpr", "auroc", "accuracy", "f1",
    "precision", "recall", "sensitivity", "specificity",
]


def score_histogram(P: DataFrame, by: list[str]) -> DataFrame:
    """(by, c, pos, neg): one row per distinct score of a group."""
    positive = (F.col("y") == 1).cast("bigint")
    return P.groupBy(*by, F.col("c").cast("double").alias("c")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def ranked_histogram(hist: DataFrame, by: list[str]) -> DataFrame:
    """Histogram plus true / false positives when accepting scores down to each row."""
    return running(
        hist,
        by,
        ["c"],
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
        descending=True,
    )


def _ratio(num: Column, den: Column, fallback: float = 0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(fallback))


# Per-score contributions to the ranking metrics, from running counts. An
# ordered pair counts +1 and a reversed one -1, so ties add nothing; precision
# before the first score is 1.
_HERE = "tp / (tp + fp)"
_BEFORE = "CASE WHEN tp + fp > pos + neg THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1.0D END"
RANK_TERMS = {
    "auc_gap": "double(tp - pos) * neg - double(fp - neg) * pos",
    "pr_area": f"pos * ({_HERE} + {_BEFORE}) * 0.5D",
    "ap_sum": f"pos * ({_HERE})",
}

_COUNTS = ["n", "pos", "neg", "tp", "fp", "tn", "fn"]


def _sums(ranked: DataFrame, by: list[str], threshold: float, bins: int) -> DataFrame:
    """One row a group. A bin's weighted gap is the distance between its summed confidence and its positives."""
    accept = f"c >= {float(threshold)!r}D"
    sums = {
        "n": "pos + neg",
        "pos": "pos",
        "neg": "neg",
        "tp": f"IF({accept}, pos, 0L)",
        "fp": f"IF({accept}, neg, 0L)",
        "tn": f"IF({accept}, 0L, neg)",
        "fn": f"IF({accept}, 0L, pos)",
        "_sq": "pos * pow(c - 1, 2) + neg * pow(c, 2)",
        **{f"_{k}": v for k, v in RANK_TERMS.items()},
    }
    binned = ranked.withColumn("_bin", upper_closed_bin(F.col("c"), bins))
    gaps = [F.abs(F.expr(f"coalesce(sum(IF(_bin = {b}, c * (pos + neg) - pos, 0.0D)), 0.0D)")) for b in range(bins)]
    return binned.groupBy(*by).agg(
        *[F.expr(f"coalesce(sum({v}), 0L)" if k in _COUNTS else f"sum({v})").alias(k) for k, v in sums.items()],
        sum(gaps[1:], gaps[0]).alias("_gap"),
    )


def _assemble(totals: DataFrame, by: list[str]) -> DataFrame:

    def guarded(value: str, empty: float) -> str:
        return f"CASE WHEN n = 0 THEN {empty}D ELSE {value} END"

    def two_class(num: str, den: str) -> str:
        """A ratio, 0 for an empty denominator; one class alone scores 1 when nothing is wrong, else 0."""
        ratio = f"CASE WHEN {den} > 0 THEN double({num}) / ({den}) ELSE 0.0D END"
        return guarded(f"CASE WHEN pos = 0 OR neg = 0 THEN IF(fp + fn = 0, 1.0D, 0.0D) ELSE {ratio} END", 0.0)

    def ranking(value: str, single: str) -> str:
        return f"CASE WHEN pos = 0 OR neg = 0 THEN {single} ELSE {value} END"

    values = {
        "n_samples": "n",
        "accuracy": guarded("(tp + tn) / n", 0.0),
        "ece": guarded("coalesce(_gap, 0.0D) / n", 1.0),
        "brier": guarded("_sq / n", 1.0),
        "precision": two_class("tp", "tp + fp"),
        "recall": two_class("tp", "tp + fn"),
        "f1": two_class("2 * tp", "2 * tp + fp + fn"),
        "sensitivity": two_class("tp", "tp + fn"),
        "specificity": two_class("tn", "tn + fp"),
        "auroc": guarded(ranking("0.5D + 0.5D * _auc_gap / (double(pos) * neg)", "0.5D"), 0.5),
        "aucpr": guarded(ranking("_pr_area / pos", "pos / n"), 0.0),
        "average_precision": guarded(ranking("_ap_sum / pos", "0.0D"), 0.0),
        "tp": "tp",
        "fp": "fp",
        "tn": "tn",
        "fn": "fn",
        "n_pos": "pos",
        "n_neg": "neg",
    }
    return totals.select(*by, *[F.expr(v).alias(k) for k, v in values.items()])


def metrics_from_histogram(hist: DataFrame, by: list[str], threshold: float = 0.5, bins: int = 10) -> DataFrame:
    return _assemble(_sums(ranked_histogram(hist, by), by, threshold, bins), by)


def all_metrics(
    P: DataFrame,
    by: list[str],
    threshold: float = 0.5,
    bins: int = 10,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Every metric, one row per group; ``groups`` lists groups that must appear even when empty."""
    out = metrics_from_histogram(score_histogram(P, by), by, threshold, bins)
    if groups is None:
        return out
    # The row of an empty group.
    empty = {"ece": 1.0, "brier": 1.0, "auroc": 0.5}
    filled = groups.select(group_key(by).alias(GROUP), *by).join(
        out.withColumn(GROUP, group_key(by)).drop(*by), GROUP, "left"
    )
    return filled.select(
        *by,
        *[
            F.coalesce(F.col(name), F.lit(empty.get(name, 0)).cast(dtype)).alias(name)
            for name, dtype in out.dtypes
            if name not in by
        ],
    )


def ece(P: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; a zero score counts in the size only."""
    binned = (
        P.withColumn("_bin", upper_closed_bin(F.col("c"), bins))
        .groupBy(*by, "_bin")
        .agg(F.count("*").alias("n"), F.sum("c").alias("conf"), F.sum(F.col("y").cast("bigint")).alias("pos"))
    )
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("conf") / F.col("n") - F.col("pos") / F.col("n")) * F.col("n"))
    return binned.withColumn("gap", gap).groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.coalesce(F.sum("gap"), F.lit(0.0)) / F.when(F.sum("n") > 0, F.sum("n")), F.lit(1.0)).alias("ece"),
    )


def reliability(P: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Accuracy and count per bin [lo, hi), last bin closed; empty bins give NaN accuracy."""
    filled = P.groupBy(*by, lower_closed_bin(F.col("c"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("accuracy")
    )
    keyed = filled.withColumn(GROUP, group_key(by))
    grid = (
        keyed.groupBy(*by, GROUP).agg(F.lit(1).alias("_one"))
        .select(*by, GROUP, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    )
    i = F.col("bin")
    return grid.join(keyed.drop(*by), [GROUP, "bin"], "left").select(
        *by,
        "bin",
        ((edge(i, bins) + edge(i + 1, bins)) / 2).alias("center"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("accuracy", F.lit(float("nan"))).alias("accuracy"),
    )


def brier(P: DataFrame, by: list[str]) -> DataFrame:
    return P.groupBy(*by).agg(
        F.coalesce(F.avg(F.pow(F.col("c") - F.col("y"), 2)), F.lit(1.0)).alias("brier")
    )


def confusion(P: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    accept = F.col("c") >= F.lit(float(threshold))
    correct = F.col("y") == 1

    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    return (
        P.groupBy(*by)
        .agg(
            count(accept & correct).alias("tp"),
            count(accept & ~correct).alias("fp"),
            count(~accept & ~correct).alias("tn"),
            count(~accept & correct).alias("fn"),
        )
        .withColumn(
            "accuracy",
            _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")),
        )
    )


def prf(P: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, sensitivity and specificity with zero for an empty denominator."""
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return confusion(P, by, threshold).select(
        *by,
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fn).alias("sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"),
    )


def auroc(P: DataFrame, by: list[str]) -> DataFrame:
    """Area under ROC, ties at half credit; 0.5 for a single class."""
    return _ranking(P, by).select(*by, "auroc")


def aucpr(P: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid area under the precision-recall points including (0, 1)."""
    return _ranking(P, by).select(*by, "aucpr")


def average_precision(P: DataFrame, by: list[str]) -> DataFrame:
    """Step-wise average precision; 0 for a single class."""
    return _ranking(P, by).select(*by, "average_precision")


def _ranking(P: DataFrame, by: list[str]) -> DataFrame:
    sums = (
        ranked_histogram(score_histogram(P, by), by)
        .groupBy(*by)
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *[F.expr(f"sum({v})").alias(k) for k, v in RANK_TERMS.items()])
    )
    both = "pos > 0 AND neg > 0"
    return sums.select(
        *by,
        F.expr(f"CASE WHEN {both} THEN 0.5D + 0.5D * auc_gap / (double(pos) * neg) ELSE 0.5D END").alias("auroc"),
        F.expr(f"CASE WHEN {both} THEN pr_area / pos WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0.0D END").alias("aucpr"),
        F.expr(f"CASE WHEN {both} THEN ap_sum / pos ELSE 0.0D END").alias("average_precision"),
    )


def metrics_by_groups(P: DataFrame, levels: list[str], threshold: float = 0.5) -> DataFrame:
    """Overall, by the first level, by the first two, and so on, in one pass over the rows.

    Grouping sets expand the finest score histogram, not the rows. ``level``
    tells the depth; columns below it are null.
    """
    hist = score_histogram(P, levels)
    sets = [levels[:k] for k in range(len(levels) + 1)]
    expanded = hist.groupingSets(
        [[F.col(x) for x in s] + [F.col("c")] for s in sets],
        *[F.col(x) for x in levels],
        F.col("c"),
    ).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        *[F.grouping(F.col(x)).alias(f"_g_{x}") for x in levels],
    )
    depth = sum((1 - F.col(f"_g_{x}").cast("int") for x in levels), F.lit(0))
    keyed = expanded.withColumn("level", depth).drop(*[f"_g_{x}" for x in levels])
    return metrics_from_histogram(keyed, ["level"] + levels, threshold)


def guarded_metrics(
    P: DataFrame, dim: DataFrame, threshold: float = 0.5, key: str = "sample_id", group: str = "dataset"
) -> DataFrame:
    """Metrics per looked-up group; a single-class group reports its counts and a tag only."""
    joined = lookup(P.drop(group), dim, key, group, "unknown")
    at_tau = all_metrics(joined, [group], threshold)
    plain = all_metrics(joined, [group]) if threshold != 0.5 else at_tau
    counts = ["tp", "tn", "fp", "fn"]
    values = ["accuracy", "ece", "brier", "precision", "recall", "f1", "sensitivity", "specificity", "auroc", "aucpr"]
    out = plain if plain is at_tau else plain.drop(*counts).join(at_tau.select(group, *counts), group)
    single = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    return out.select(
        group,
        "n_samples",
        F.col("n_pos").alias("n_correct"),
        F.when(single, F.lit("single_class_in_subset")).alias("error"),
        *[F.when(~single, F.col(v)).alias(v) for v in values + counts],
    )


def predict(P: DataFrame, threshold: float = 0.5) -> DataFrame:
    predicted = (F.col("c") >= F.lit(float(threshold))).cast("int")
    return P.withColumn("predicted", predicted).withColumn("is_match", (predicted == F.col("y")).cast("int"))


def _sens(tp: Column, fn: Column) -> Column:
    return tp / (tp + fn + F.lit(1e-12))


def youden(P: DataFrame, by: list[str], grid: int = 1001) -> DataFrame:
    """Threshold of a 0..1 grid with the largest sensitivity + specificity - 1, first on ties.

    Scores fall onto grid cells first; only the cells that hold scores can
    change the counts, so a group needs at most ``grid`` + 1 rows.
    """
    steps = grid - 1
    cells = P.groupBy(*by, grid_index(F.col("c"), steps).alias("cell")).agg(
        F.sum((F.col("y") == 1).cast("bigint")).alias("pos"),
        F.sum((F.col("y") != 1).cast("bigint")).alias("neg"),
    )
    # a closing cell past the grid: the thresholds above every score
    closing = F.array(F.struct("cell", "pos", "neg"), F.struct(
        F.lit(steps + 1).alias("cell"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")))
    spread = cells.select(*by, F.explode(closing).alias("s")).groupBy(*by, F.col("s.cell").alias("cell")).agg(
        F.sum("s.pos").alias("pos"), F.sum("s.neg").alias("neg"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = spread.select(
        *by,
        "cell",
        F.greatest(F.coalesce(F.lag("cell").over(group.orderBy("cell")) + 1, F.lit(0)), F.lit(0)).alias("step"),
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("tn"),
        F.sum("pos").over(group).alias("n_pos"),
        F.sum("neg").over(group).alias("n_neg"),
    )
    tp, fp = F.col("n_pos") - F.col("fn"), F.col("n_neg") - F.col("tn")
    sens, spec = _sens(tp, F.col("fn")), _sens(F.col("tn"), fp)
    usable = (F.col("step") <= F.col("cell")) & (F.col("step") <= steps)
    j = F.when(usable, sens + spec - F.lit(1.0))
    scored = counted.select(
        *by, "step", "n_pos", "n_neg", sens.alias("sens"), spec.alias("spec"), F.when(j > -1.0, j).alias("j")
    )
    best = scored.groupBy(*by).agg(
        F.max_by(
            F.struct("step", "sens", "spec", "j"),
            F.when(F.col("j").isNotNull(), F.struct(F.col("j"), -F.col("step"))),
        ).alias("b")
    )
    return best.select(
        *by,
        F.coalesce(edge(F.col("b.step"), steps), F.lit(0.5)).alias("tau"),
        F.col("b.sens").alias("sens"),
        F.col("b.spec").alias("spec"),
        F.col("b.j").alias("j"),
    )


def sens_spec(P: DataFrame, by: list[str], tau: float) -> DataFrame:
    counts = confusion(P, by, tau)
    return counts.select(
        *by, _sens(F.col("tp"), F.col("fn")).alias("sens"), _sens(F.col("tn"), F.col("fp")).alias("spec")
    )


def composite(auroc_: Column, ece_: Column, w: float = 0.6) -> Column:
    return F.lit(w) * auroc_ + F.lit(1.0 - w) * (F.lit(1.0) - ece_)


def penalised(auroc_: Column, ece_: Column) -> Column:
    return auroc_ * (F.lit(1.0) - ece_)


def constrained(auroc_: Column, ece_: Column, sens: Column, spec: Column,
                w: float = 0.6, min_sens: float = 0.6, min_spec: float = 0.6) -> Column:
    feasible = (sens >= min_sens) & (spec >= min_spec)
    return F.when(feasible, composite(auroc_, ece_, w)).otherwise(F.lit(float("-inf")))


def validation_score(
    P: DataFrame, by: list[str], name: str, w: float = 0.6, min_sens: float = 0.6, min_spec: float = 0.6
) -> DataFrame:
    """One score per group by the name of the selection metric."""
    if name == "validation_loss":
        return bce(P, by).select(*by, (-F.col("bce")).alias("score"))
    base = all_metrics(P, by)
    a, e = F.col("auroc"), F.col("ece")
    simple = {"auroc": a, "ece": 1.0 - e, "composite": composite(a, e, w), "auroc_with_constraint": penalised(a, e)}
    if name in simple:
        return base.select(*by, simple[name].alias("score"))
    if name == "composite_with_constraints":
        point = youden(P, by)
        # without a usable threshold the operating point is taken at 0.5
        default = sens_spec(P, by, 0.5).select(*by, F.col("sens").alias("_s"), F.col("spec").alias("_p"))
        keyed = [d.withColumn(GROUP, group_key(by)).drop(*by) for d in (point, default)]
        joined = base.withColumn(GROUP, group_key(by)).join(keyed[0], GROUP).join(keyed[1], GROUP)
        sens, spec = F.coalesce("sens", "_s"), F.coalesce("spec", "_p")
        return joined.select(*by, constrained(a, e, sens, spec, w, min_sens, min_spec).alias("score"))
    raise ValueError(f"unknown validation metric: {name}")


def bce(P: DataFrame, by: list[str]) -> DataFrame:
    eps = F.lit(1e-7)
    y, c = F.col("y"), F.col("c")
    term = y * F.log(c + eps) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - c + eps)
    return P.groupBy(*by).agg((-F.avg(term)).alias("bce"))


def confidence_summary(P: DataFrame, by: list[str]) -> DataFrame:
    return P.groupBy(*by).agg(
        F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.min("c").alias("min"), F.max("c").alias("max")
    )


def pos_weight(df: DataFrame, by: list[str]) -> DataFrame:
    pos = F.sum((F.col("y") == 1).cast("bigint"))
    neg = F.sum((F.col("y") == 0).cast("bigint"))
    return df.groupBy(*by).agg(F.when(pos > 0, neg / F.when(pos > 0, pos)).otherwise(F.lit(1.0)).alias("pos_weight"))


def flip(P: DataFrame) -> DataFrame:
    """The same pairs seen as confidence in the answer being wrong."""
    return P.withColumns({"y": 1 - F.col("y"), "c": F.lit(1.0) - F.col("c")})


def coverage(P: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Scored versus listed rows per group; ``totals`` has (by, n_total)."""
    scored = P.groupBy(*by).agg(F.count("*").alias("n_scored"))
    keyed = scored.withColumn(GROUP, group_key(by)).drop(*by)
    return totals.withColumn(GROUP, group_key(by)).join(keyed, GROUP, "left").select(
        *by,
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        "n_total",
        (F.coalesce("n_scored", F.lit(0)) / F.when(F.col("n_total") > 0, F.col("n_total"))).alias("coverage"),
    )
