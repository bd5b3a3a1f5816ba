"""Confidence per response from likelihoods, prompts, probes and judged replies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import first_number, verbal_confidence
from ..functions.vectors import view_cosine
from .joins import last_per_key

# Probe weights travel to every task; larger models are refused rather than shipped.
MAX_WEIGHT_BYTES = 512 * 1024 * 1024


def sequence_likelihood(tokens: DataFrame, by: list[str], logprob: str = "logprob") -> DataFrame:
    """Geometric mean of token probabilities; a missing log-probability counts as -100."""
    p = F.exp(F.coalesce(F.col(logprob), F.lit(-100.0)))
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))
    return tokens.groupBy(*by).agg(F.exp(F.avg(F.log(clipped))).alias("confidence"))


def likelihood_of_array(logprobs: Column) -> Column:
    """The same for an array of log-probabilities; an empty array gives 0."""
    logs = F.transform(
        logprobs,
        lambda x: F.log(F.least(F.greatest(F.exp(F.coalesce(x, F.lit(-100.0))), F.lit(1e-12)), F.lit(1.0))),
    )
    n = F.size(logprobs)
    mean = F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + x) / F.when(n > 0, n)
    return F.coalesce(F.exp(mean), F.lit(0.0))


def ensemble(df: DataFrame, by: list[str], how: str = "mean", first_n: int | None = None,
             index: str = "q_idx", conf: str = "c", ok: str = "ok") -> DataFrame:
    """One confidence per sample from its original prompt (index 0) and paraphrases.

    Only successful prompts count; a sample without a successful original is
    dropped. The list of confidences is part of the record, so its length is the
    number of prompts of one sample.
    """
    used = df.where(F.col(ok)) if first_n is None else df.where(F.col(ok) & (F.col(index) <= first_n))
    value = F.col(conf)
    pick = {"mean": F.avg(value), "median": F.median(value), "min": F.min(value), "max": F.max(value)}
    grouped = used.groupBy(*by).agg(
        pick.get(how, F.avg(value)).alias("confidence"),
        F.max(F.when(F.col(index) == 0, value)).alias("original_confidence"),
        F.count("*").alias("num_prompts_used"),
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(index), value.alias("v")))), lambda s: s["v"]
        ).alias("all_confidences"),
    )
    return grouped.where(F.col("original_confidence").isNotNull())


def two_stage_confidence(replies: DataFrame, judged: DataFrame, key: str = "sample_id",
                         reply: str = "reply", judge: str = "judge_text") -> DataFrame:
    """Stated confidence, else the first number of the judge's text, else failed. Of repeated judged keys one counts."""
    joined = replies.join(last_per_key(judged.select(key, judge), key), key, "left")
    own, other = verbal_confidence(F.col(reply)), first_number(F.col(judge))
    return joined.withColumns({"_own": own, "_other": other}).select(
        key,
        F.coalesce("_own", "_other").alias("confidence"),
        F.when(F.col("_own").isNotNull(), F.lit("stated"))
        .when(F.col("_other").isNotNull(), F.lit("judged"))
        .otherwise(F.lit("failed"))
        .alias("status"),
    )


def run_average(df: DataFrame, by: list[str], conf: str = "c") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(conf).alias("confidence"), F.count("*").alias("n_runs"))


def linear_score(vec: Column, weights: list[float], bias: float) -> Column:
    """Logit of a linear probe, evaluated without leaving the JVM."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vec, w, lambda x, y: x * y), F.lit(float(bias)), lambda acc, t: acc + t)


def mlp_score(df: DataFrame, vec: str, layers: list[tuple[np.ndarray, np.ndarray]], out: str = "confidence") -> DataFrame:
    """Dense + ReLU layers, a linear output and a sigmoid over a vector column.

    ``layers`` holds (weights [n_out, n_in], bias [n_out]) in order; the last has
    one output. A single layer is the linear probe.
    """
    size = sum(w.nbytes + b.nbytes for w, b in layers)
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"probe weights take {size} bytes, more than {MAX_WEIGHT_BYTES}")
    shipped = df.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])

    @F.pandas_udf(DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=float)
        x = np.stack(vectors.to_numpy()).astype(float)
        stack = shipped.value
        for w, b in stack[:-1]:
            x = np.maximum(x @ w.T + b, 0.0)
        w, b = stack[-1]
        z = (x @ w.T + b)[:, 0]
        return pd.Series(1.0 / (1.0 + np.exp(-z)))

    return df.withColumn(out, score(F.col(vec)))


def view_diagnostics(base: DataFrame, views: DataFrame, key: str = "sample_id") -> DataFrame:
    """Cosine to base, change of the base token's probability and top-token flip, per view.

    ``base``: key, h, p_top1, top1. ``views``: key, view, h, p_of_base, top1, mask.
    Of repeated base keys one counts.
    """
    b = last_per_key(base.select(key, "h", "p_top1", "top1"), key).select(key, F.col("h").alias("_h"), F.col("p_top1").alias("_p"), F.col("top1").alias("_t"))
    seen = F.col("mask") == 1
    nan = F.lit(float("nan"))
    gap = F.abs(F.col("_p") - F.col("p_of_base"))
    known = (F.col("top1") >= 0) & (F.col("_t") >= 0)
    return views.join(b, key).select(
        key,
        "view",
        F.when(seen, view_cosine(F.col("_h"), F.col("h"))).otherwise(nan).alias("cos_base"),
        F.when(seen, F.coalesce(gap, nan)).otherwise(nan).alias("dp"),
        F.when(seen & known, (F.col("top1") != F.col("_t")).cast("int")).otherwise(F.lit(-1)).alias("flip"),
    )


def aggregate_attention(df: DataFrame, by: list[str], how: str = "mean") -> DataFrame:
    """Attention per position over layers and heads, normalised per sample.

    Input rows: by.., layer, head, weights (array over positions). Positions come
    out in order as one array per sample, as long as its longest row that counts; a position
    counts the rows that reach it, and a null weight is as if its row did not.
    One exchange; a task adds up the nested lists of one sample, its own field.
    """
    if how not in ("mean", "max", "last_layer"):
        raise ValueError(f"unknown attention aggregation: {how}")
    kept = df.select(*by, F.col("layer").cast("double").alias("layer"), F.col("weights").cast("array<double>").alias("weights"))
    schema = StructType([*kept.schema.fields[: len(by)], StructField("attention", ArrayType(DoubleType()))])

    def pooled(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = rows["weights"].combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        layers, layer = np.unique(rows["layer"].to_numpy(), return_inverse=True)
        flat = lists.flatten()
        ends = np.cumsum(sizes)
        at, of = np.arange(len(flat)) - np.repeat(ends - sizes, sizes), np.repeat(layer, sizes)
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        used_rows = layer == len(layers) - 1 if how == "last_layer" else np.full(len(layer), True)
        known &= np.repeat(used_rows, sizes)
        shape = (len(layers), int(sizes[used_rows].max(initial=0)))
        value, cell = flat.fill_null(0.0).to_numpy(zero_copy_only=False)[known], (of[known], at[known])
        seen = np.zeros(shape)
        np.add.at(seen, cell, 1)
        if how == "max":
            whole = np.full(shape, -np.inf)
            np.maximum.at(whole, cell, value)
            out, reached = whole.max(axis=0), seen.any(axis=0)
        else:
            whole = np.zeros(shape)
            np.add.at(whole, cell, value)
            mean = np.divide(whole, seen, out=np.zeros(shape), where=seen > 0)
            used = (seen > 0).sum(axis=0)
            out, reached = mean.sum(axis=0) / np.maximum(used, 1), used > 0
        scale = out[reached].sum()
        if scale > 0:
            out = out / scale
        packed = pa.ListArray.from_arrays(pa.array([0, shape[1]], pa.int32()), pa.array(out, mask=~reached))
        return pa.table([*[rows[c].slice(0, 1) for c in by], packed], names=schema.names)

    return kept.groupBy(*by).applyInArrow(pooled, schema)
