"""Deterministic partners, contrast pairs and within-batch similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..functions.keys import other_position, row_draw, row_seed
from .ordered import dense_index


def random_partner(df: DataFrame, key: str, cols: list[str], seed: int = 42,
                   salt: str = "partner") -> DataFrame:
    """Each row with another row of the table, chosen by its seed; a lone row pairs with itself.

    Partners are met by an equi-join on a dense position, which spreads evenly.
    """
    placed = dense_index(df, key)
    n, own = F.col("n_total"), F.col("idx")
    other = other_position(row_draw(F.col(key).cast("string"), seed, salt), own, n)
    anchors = placed.withColumn("_pick", other).drop("idx", "n_total")
    pool = placed.select(
        F.col("idx").alias("_pick"), F.col(key).alias(f"other_{key}"), *[F.col(c).alias(f"other_{c}") for c in cols]
    )
    return anchors.join(pool, "_pick").drop("_pick")


def contrast_pairs(df: DataFrame, key: str, label: str, cols: list[str], seed: int = 42) -> DataFrame:
    """Anchor and random other; ``pair_label`` is 1 when the labels differ."""
    pairs = random_partner(df, key, [label] + cols, seed, "pair")
    return pairs.withColumn("pair_label", (F.col(label) != F.col(f"other_{label}")).cast("int"))


def assign_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Batches of ``size`` consecutive rows along the key."""
    return dense_index(df, key).withColumn("batch", F.expr(f"idx div {size}")).drop("n_total")


def _members(batched: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    length = F.greatest(V.l2(F.col(vec)), F.lit(1e-12))
    unit = V.let(length, lambda n: F.transform(F.col(vec), lambda x: x / n))
    member = F.struct(F.col("idx"), F.col(key).alias("key"), F.col(label).alias("y"), unit.alias("e"))
    # at most one batch of rows, by construction of the batch number
    return batched.groupBy("batch").agg(F.sort_array(F.collect_list(member)).alias("m"))


def batch_similarity(df: DataFrame, key: str, label: str, vec: str, size: int = 32) -> DataFrame:
    """Per anchor: how many same- and other-class rows its batch has and how similar they are."""
    packed = _members(assign_batches(df, key, size), key, label, vec)

    def describe(a: Column) -> Column:
        same = F.filter("m", lambda b: (b["y"] == a["y"]) & (b["idx"] != a["idx"]))
        diff = F.filter("m", lambda b: b["y"] != a["y"])

        def mean(group: Column) -> Column:
            sims = F.transform(group, lambda b: V.dot(a["e"], b["e"]))
            n = F.size(group)
            return V.total(sims) / F.when(n > 0, n)

        return F.struct(
            a["key"].alias(key), a["y"].alias(label),
            F.size(same).alias("n_same"), F.size(diff).alias("n_diff"),
            mean(same).alias("same_similarity"), mean(diff).alias("diff_similarity"),
        )

    return packed.select("batch", F.inline(F.transform("m", describe)))


def supcon_loss(df: DataFrame, key: str, label: str, vec: str, size: int = 32, temperature: float = 0.1,
                seed: int = 42) -> DataFrame:
    """Contrastive loss per batch: one seeded positive against all negatives of the batch.

    Anchors without a positive or a negative are skipped.
    """
    packed = _members(assign_batches(df, key, size), key, label, vec)

    def anchor_loss(a: Column) -> Column:
        same = F.filter("m", lambda b: (b["y"] == a["y"]) & (b["idx"] != a["idx"]))
        diff = F.filter("m", lambda b: b["y"] != a["y"])
        usable = (F.size(same) > 0) & (F.size(diff) > 0)
        draw = F.pmod(row_seed(a["key"].cast("string"), seed, "positive"), F.greatest(F.size(same), F.lit(1)))
        chosen = F.try_element_at(same, (draw + 1).cast("int"))
        negatives = F.transform(diff, lambda b: V.dot(a["e"], b["e"]) / temperature)
        loss = V.log_sum_exp(negatives) - V.dot(a["e"], chosen["e"]) / temperature
        return F.when(usable, loss)

    losses = packed.select("batch", F.explode(F.transform("m", anchor_loss)).alias("loss"))
    return losses.groupBy("batch").agg(
        F.count("loss").alias("n_anchors"), F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss")
    )


def pair_loss(pairs: DataFrame, a: str, b: str, margin: float = 1.0) -> DataFrame:
    """Mean of d^2 for equal labels and max(0, margin - d)^2 for different ones."""
    # Fixed value: 1e-6 is added to every difference before the norm.
    d = V.l2(F.zip_with(a, b, lambda x, y: x - y + F.lit(1e-6)))
    label = F.col("pair_label")
    gap = F.greatest(F.lit(margin) - F.col("_d"), F.lit(0.0))
    return pairs.withColumn("_d", d).agg(
        F.avg((1 - label) * F.pow(F.col("_d"), 2) + label * F.pow(gap, 2)).alias("loss"), F.count("*").alias("n_pairs")
    )
