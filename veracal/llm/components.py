"""Connected components of a link table, and grouped all-against-all work cut into tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable, for every node of the links (``a``, ``b``), both bigint and not null.

    Alternating star contraction: every node hands its neighbours to the smallest
    one it knows, first the larger ones, then the smaller ones, until each
    component is a star. Minima are pre-aggregated, so a node with a third of all
    links is no hot group; the number of rounds grows with the logarithm of the
    longest chain.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def tiles(rows: DataFrame, group: list[str], node: str, block_rows: int, least: int = 1, block_load: int | None = None) -> DataFrame:
    """Lay out every group so that each pair of its rows meets in one tile of bounded size.

    Rows of a group fall into blocks of about ``block_rows`` by a hash of ``node``;
    each row goes to the tiles of its block with every block, as side 0 or 1
    (``_i`` = ``_j``: the block with itself). A hot group becomes more tiles, not a larger one.
    Groups of fewer than ``least`` rows are left out. With ``block_load`` a block holds about that much of ``_load`` at most.
    """
    blocks = F.count("*") / float(block_rows)
    if block_load is not None:
        blocks = F.greatest(blocks, F.sum("_load") / float(block_load))
    counted = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.ceil(blocks).alias("_blocks")).where(F.col("_n") >= least).select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_blocks").alias("_n")
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    on = same[0]
    for s in same[1:]:
        on = on & s
    block = F.pmod(F.xxhash64(node, F.lit(7)), F.col("_n"))
    spread = rows.join(counted, on).withColumn("_b", block).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return spread.select(
        *rows.columns, F.least("_b", "_k").alias("_i"), F.greatest("_b", "_k").alias("_j"),
        (F.col("_b") > F.col("_k")).cast("int").alias("_side"),
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the components of the given links: each node to the smallest of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
