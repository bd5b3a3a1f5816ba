"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target is a multiple r of its size. Every document is taken floor(r)
times, and once more with probability r - floor(r). Which documents get the
extra copy is drawn by the flight phase of the cube method: inclusion
probabilities move through the null-space of the balancing constraints (number
of documents and number of words), so both totals stay what they were while
probabilities become 0 or 1. At most two documents of a block stay undecided;
these meet in blocks of the next level, until two of each source are left, whose
landing is one systematic draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import ranked, stored, unit

BLOCK_ROWS = 1024
EPS = 1e-9


@pandas_udf(LongType())
def word_count(text: pd.Series) -> pd.Series:
    """Number of runs of bytes other than the six ASCII white-space characters."""
    return pd.Series([len(t.encode("utf-8", "surrogatepass").split()) if t is not None else 0 for t in text], dtype="int64")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``target`` of each row (source, source_size).

    Sources in code point order, null last, get the weights in turn. They share
    ``share`` times all words by weight; a target stops at ``cap`` times the
    source's size, and what it leaves goes to the others by weight. The level at
    which that ends is found by sums over the sources, two numbers a round.
    """
    at = ranked(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    at = at.withColumn("_w", weight).withColumn("_most", F.col("source_size") * cap)
    level = 0.0
    budget = (at.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = F.col("_most") <= F.col("_w") * level
        held, open_w = at.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_w")))).first()
        new = (budget - (held or 0.0)) / open_w if open_w else level
        if new <= level:
            break
        level = new
    return at.select("source", "source_size", F.least("_most", F.col("_w") * level).alias("target"))


def _move(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase over one block: a window of three documents at a time, one of which is decided in each step."""
    p = p.copy()
    window: list[int] = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = round(p[k])
            continue
        window.append(k)
        if len(window) < 3:
            continue
        i, j, l = window
        # the direction that changes neither the number of documents nor that of words
        u = np.array([size[j] - size[l], size[l] - size[i], size[i] - size[j]], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        u /= np.abs(u).max()
        x = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
            down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
        x = x + u * (up if draw[k] * (up + down) < down else -down)
        p[window] = np.where(x < EPS, 0.0, np.where(x > 1 - EPS, 1.0, x))
        window = [m for m in window if 0 < p[m] < 1]
    return p


def _flight(block: pd.DataFrame) -> pd.DataFrame:
    # largest first, so that what stays undecided is small
    block = block.sort_values(["_words", "_draw", "_unit"], ascending=[False, True, True], kind="stable")
    block["_p"] = _move(block["_p"].to_numpy(), block["_words"].to_numpy(float), block["_draw"].to_numpy())
    return block


def _land(block: pd.DataFrame) -> pd.DataFrame:
    """At most two documents of a source: one systematic draw, which keeps their number to the nearest whole."""
    block = block.sort_values(["_draw", "_unit"], kind="stable")
    start, ends = float(block["_draw"].iloc[0]), np.cumsum(block["_p"].to_numpy())
    block["_p"] = np.floor(ends - start + 1) - np.floor(np.concatenate([[0.0], ends[:-1]]) - start + 1)
    return block


def mix(
    docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5, cap: float = 2.0, seed: int = 0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """How often each document is taken.

    Returns one row per input row: ``id``, ``source``, ``digest`` (of the text), ``size``
    (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words). Rows alike in id,
    source and text are one unit and are decided together. A null text has no
    words; a null source is a source. Draws are functions of the rows' values,
    so a rerun decides alike.
    """
    keys = ["_id", "_source", "_digest", "_size"]
    units = stored(
        docs.select(
            F.col(id).alias("_id"), F.col(source).alias("_source"), F.xxhash64(F.col(text)).alias("_digest"),
            word_count(F.col(text)).alias("_size"),
        ).groupBy(*keys).agg(F.count("*").alias("_rows")),
        "mixing",
    )
    sizes = stored(
        units.groupBy(F.col("_source").alias("source")).agg(
            F.sum(F.col("_size") * F.col("_rows")).alias("source_size"), F.count("*").alias("_units")
        ),
        "mixing",
    )
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    per = targets.join(sizes.drop("source_size"), targets["source"].eqNullSafe(sizes["source"])).select(
        targets["source"].alias("_s"), "source_size", "target", "_units"
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(per, units["_source"].eqNullSafe(per["_s"])).drop("_s").select(
        *keys, "_rows", "source_size", "target",
        F.floor(ratio + EPS).alias("_whole"),
        (ratio - F.floor(ratio + EPS)).alias("_p"),
        (F.col("_size") * F.col("_rows")).alias("_words"),
        unit(*keys, seed=seed).alias("_draw"),
        F.xxhash64(*keys, F.lit(seed + 1)).alias("_unit"),
        F.ceil(F.col("_units") / float(block_rows)).alias("_blocks"),
    )
    decided, level = None, 0
    blocks = rows.agg(F.max("_blocks")).first()[0] or 0
    while blocks:
        laid = rows.withColumn("_block", F.pmod(F.xxhash64("_unit", F.lit(level)), F.col("_blocks")))
        moved = stored(laid.groupBy("_source", "_block").applyInPandas(_flight, laid.schema).drop("_block"), "mixing")
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        done = moved.where(~open_)
        decided = done if decided is None else decided.unionByName(done)
        rows = moved.where(open_).withColumn("_blocks", F.ceil(F.col("_blocks") * 2 / float(block_rows)))
        # two of each block are left; one block of each source is the last level
        blocks, level = (-(-blocks * 2 // block_rows) if blocks > 1 else 0), level + 1
    landed = rows.groupBy("_source").applyInPandas(_land, rows.schema)
    decided = landed if decided is None else decided.unionByName(landed)
    copies = F.col("_whole") + F.col("_p").cast("bigint")
    return decided.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int")))).select(
        F.col("_id").alias(id), F.col("_source").alias(source), F.col("_digest").alias("digest"), F.col("_size").alias("size"),
        "source_size", "target", copies.alias("copies"), (F.col("_size") * copies).alias("taken"),
    )


def mixed(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mix itself: the input's rows and columns, each as often as it is taken."""
    chosen = mix(docs, text, id, source, **how).where(F.col("copies") > 0).select(
        F.col(id).alias("_m_id"), F.col(source).alias("_m_source"), F.col("digest").alias("_m_digest"), "copies"
    ).distinct()
    same = (
        docs[id].eqNullSafe(chosen["_m_id"]) & docs[source].eqNullSafe(chosen["_m_source"])
        & (F.xxhash64(docs[text]) == chosen["_m_digest"])
    )
    return docs.join(chosen, same).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*[docs[c] for c in docs.columns])
