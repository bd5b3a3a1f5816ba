"""Probe losses, a linear probe fitted by distributed gradients, and trial bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .confidence import linear_score
from .metrics import pos_weight
from .ordered import running

# Loss terms of the named variants.
VARIANTS = {
    "full": (True, True),
    "no_rank": (False, True),
    "no_brier": (True, False),
    "bce_only": (False, False),
}


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def loss_terms(df: DataFrame, weights: list[float], bias: float = 0.0, margin: float = 0.1) -> DataFrame:
    """One row (bce, brier, rank) of a linear probe over (h_base, h_blank, y, mask), in one pass."""
    pw = pos_weight(df, []).scalar()
    z = df.select(
        linear_score(F.col("h_base"), weights, bias).alias("z"),
        linear_score(F.col("h_blank"), weights, bias).alias("zk"),
        F.col("y").cast("double").alias("y"),
        F.col("mask").cast("double").alias("m"),
    ).withColumn("pw", pw)
    p, pk, y = 1.0 / (1.0 + F.exp(-F.col("z"))), 1.0 / (1.0 + F.exp(-F.col("zk"))), F.col("y")
    bce = F.avg(F.col("pw") * y * _softplus(-F.col("z")) + (1.0 - y) * _softplus(F.col("z")))
    brier = F.avg(F.pow(p - y, 2))
    active = y * F.col("m")
    rank = F.sum(F.greatest(F.lit(0.0), F.lit(margin) - (p - pk)) * active) / (F.sum(active) + F.lit(1e-8))
    return z.agg(bce.alias("bce"), brier.alias("brier"), rank.alias("rank"))


def _combined(variant: str, beta: float, lam: float) -> Column:
    use_rank, use_brier = VARIANTS[variant]
    whole = F.col("bce")
    if use_brier:
        whole = whole + F.lit(beta) * F.col("brier")
    if use_rank:
        whole = whole + F.lit(lam) * F.col("rank")
    return whole


def probe_loss(df: DataFrame, weights: list[float], bias: float = 0.0, variant: str = "full",
               beta: float = 1.0, lam: float = 1.0, margin: float = 0.1) -> DataFrame:
    """Loss terms and their sum for one variant."""
    return loss_terms(df, weights, bias, margin).withColumn("loss", _combined(variant, beta, lam))


def loss_variants(df: DataFrame, weights: list[float], bias: float = 0.0, beta: float = 1.0, lam: float = 1.0,
                  margin: float = 0.1) -> DataFrame:
    """The loss of every variant; the terms are computed once."""
    rows = [F.struct(F.lit(v).alias("variant"), _combined(v, beta, lam).alias("loss")) for v in VARIANTS]
    return loss_terms(df, weights, bias, margin).select(F.inline(F.array(*rows)))


def fit_linear(df: DataFrame, variant: str = "full", steps: int = 50, lr: float = 0.5,
               beta: float = 1.0, lam: float = 1.0, margin: float = 0.1) -> tuple[np.ndarray, float, list[float]]:
    """Full-batch gradient steps, clipped to norm 1, from zero weights.

    Each step is one distributed aggregate: every partition adds up its own
    gradient and the driver sees one number per weight.
    """
    use_rank, use_brier = VARIANTS[variant]
    data = df.select("h_base", "h_blank", "y", "mask").persist()
    try:
        head = data.agg(
            F.max(F.size("h_base")).alias("d"),
            F.count("*").alias("n"),
            F.sum((F.col("y") == 1).cast("bigint")).alias("pos"),
            F.sum(F.col("y") * F.col("mask")).alias("active"),
        ).first()
        dim, n, pos = head["d"], head["n"], head["pos"]
        pw = (n - pos) / pos if pos else 1.0
        active = float(head["active"] or 0) + 1e-8
        theta, history = np.zeros(dim + 1), []
        for _ in range(steps):
            grad, loss = _gradient(data, theta, n, pw, active, use_rank, use_brier, beta, lam, margin)
            norm = float(np.linalg.norm(grad))
            theta = theta - lr * grad * min(1.0, 1.0 / (norm + 1e-6))
            history.append(loss)
        return theta[:-1], float(theta[-1]), history
    finally:
        data.unpersist()


def _gradient(data, theta, n, pw, active, use_rank, use_brier, beta, lam, margin):
    shipped = data.sparkSession.sparkContext.broadcast(theta)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shipped.value
        grad, loss = np.zeros(len(t)), 0.0
        for b in batches:
            if len(b) == 0:
                continue
            x = np.column_stack([np.stack(b["h_base"].to_numpy()).astype(float), np.ones(len(b))])
            y = b["y"].to_numpy(float)
            z = x @ t
            p = 1.0 / (1.0 + np.exp(-z))
            dz = ((1 - y) * p - pw * y * (1 - p)) / n
            loss += float(np.sum(pw * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z))) / n
            if use_brier:
                dz += beta * 2 * (p - y) * p * (1 - p) / n
                loss += beta * float(np.sum((p - y) ** 2)) / n
            if use_rank:
                xk = np.column_stack([np.stack(b["h_blank"].to_numpy()).astype(float), np.ones(len(b))])
                pk = 1.0 / (1.0 + np.exp(-(xk @ t)))
                w = y * b["mask"].to_numpy(float) / active
                gap = margin - (p - pk)
                on = (gap > 0) * w
                loss += lam * float(np.sum(gap * on))
                dz -= lam * on * p * (1 - p)
                grad += xk.T @ (lam * on * pk * (1 - pk))
            grad += x.T @ dz
        yield pd.DataFrame({"i": np.arange(len(t) + 1), "v": np.append(grad, loss)})

    rows = data.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    shipped.unpersist()
    values = np.zeros(len(theta) + 1)
    for r in rows:
        values[r["i"]] = r["v"]
    return values[:-1], float(values[-1])


def fit_ml(df: DataFrame, layers: str = "0", vec: str = "h_base", label: str = "y", seed: int = 42, max_iter: int = 50):
    """Spark ML probe: "0" is a weighted logistic regression, otherwise hidden layer sizes."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label"))
    if layers == "0":
        pw = pos_weight(df.select(F.col(label).alias("y")), []).first()[0]
        data = data.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(pw))).otherwise(F.lit(1.0)))
        return LogisticRegression(weightCol="weight", maxIter=max_iter).fit(data)
    dim = df.select(F.size(vec)).first()[0]
    sizes = [dim] + [int(x) for x in layers.split(",") if x.strip()] + [2]
    return MultilayerPerceptronClassifier(layers=sizes, seed=seed, maxIter=max_iter).fit(data)


def score_ml(model, df: DataFrame, vec: str = "h_base", out: str = "c") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("features", array_to_vector(vec)))
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def param_count(layers: Column, dim: int) -> Column:
    """Weights and biases of a probe given by its layer string; "0" is one linear layer."""
    hidden = F.transform(F.split(layers, ","), lambda x: F.trim(x).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(dim).cast("bigint").alias("last"))
    walked = F.aggregate(
        hidden, start, lambda acc, h: F.struct((acc["n"] + acc["last"] * h + h).alias("n"), h.alias("last"))
    )
    return F.when(layers == "0", F.lit(dim + 1).cast("bigint")).otherwise(walked["n"] + walked["last"] + 1)


def within_budget(df: DataFrame, layers: str, dim: int, least: int = 1, most: int = 5_000_000) -> DataFrame:
    counted = df.withColumn("n_params", param_count(F.col(layers), dim))
    return counted.where(F.col("n_params").between(least, most))


def config_grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """All combinations of the listed parameter values, numbered."""
    grid = spark.range(1).drop("id")
    for name, values in space.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.withColumn("config", F.xxhash64(*space))


def replay_early_stop(hist: DataFrame, patience: int = 20, trial: str = "trial", epoch: str = "epoch",
                      score: str = "score", point: list[str] | None = None) -> DataFrame:
    """Best epoch and score of every trial as training would have stopped, and the ``point`` columns of that epoch.

    Rows are evaluations; epochs between them may be missing. Only a strictly
    larger score resets the patience, and a null or NaN score is never larger;
    training ends at the first evaluation with ``patience`` misses in a row. A
    trial without any usable score has null results.
    """
    point = point or []
    given = hist.select(trial, epoch, F.when(~F.isnan(score), F.col(score)).alias(score), *point)
    seen = running(given, [trial], [epoch], {"_n": ("sum", F.lit(1).cast("bigint")), "_best": ("peak", F.col(score))})
    misses = F.col("_n") - F.coalesce("_best_row", F.lit(0))
    # the row at which training ends knows which row was the best until then
    here = F.struct(epoch, F.col("_best_row").alias("row"))
    ended = seen.groupBy(trial).agg(
        F.min_by(here, F.when(misses >= patience, F.col(epoch))).alias("_stop"), F.max_by(here, F.col(epoch)).alias("_final")
    ).select(
        F.col(trial).alias("_trial"), F.coalesce("_stop", "_final").alias("_end"), F.col("_stop").isNotNull().alias("stopped_early")
    )
    rises = seen.where(F.col("_n") == F.col("_best_row"))
    best = ended.join(rises, F.col("_trial").eqNullSafe(F.col(trial)) & (F.col("_end.row") == F.col("_n")), "left")
    return best.select(F.col("_trial").alias(trial), F.col(epoch).alias("best_epoch"), F.col(score).alias("best_score"),
                       F.col(f"_end.{epoch}").alias("last_epoch"), "stopped_early", *point)


def drop_infeasible(hist: DataFrame, min_sens: float = 0.6, min_spec: float = 0.6, trial: str = "trial",
                    epoch: str = "epoch", start: int = 2) -> DataFrame:
    """Trials that stay above both floors from the given epoch on."""
    bad = hist.where(
        (F.col(epoch) >= start) & ((F.col("sens") < min_sens) | (F.col("spec") < min_spec))
    ).select(trial).distinct()
    return hist.join(bad, trial, "left_anti")
