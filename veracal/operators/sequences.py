"""Token rows and feature sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import pad


def token_rows(samples: DataFrame, features: list[str], tokens: str = "tokens") -> DataFrame:
    """One row per token in a fixed column order; a feature that is absent becomes NaN.

    ``tokens`` is an array of structs with token_id, token_str and any features.
    """
    have = set(samples.schema[tokens].dataType.elementType.names)
    exploded = samples.select(
        *[c for c in samples.columns if c != tokens], F.posexplode(tokens).alias("token_idx", "_t")
    )
    nan = F.lit(float("nan"))

    def field(name: str) -> Column:
        return F.coalesce(F.col(f"_t.{name}").cast("double"), nan) if name in have else nan

    return exploded.select(
        *[c for c in exploded.columns if c != "_t"],
        F.col("_t.token_id").alias("token_id"),
        F.col("_t.token_str").alias("token_str"),
        *[field(f).alias(f) for f in features],
    )


def _clean(name: str, eps_high: float) -> Column:
    x = F.col(name).cast("double")
    infinite = F.abs(x) == float("inf")
    if name == "epsilon_to_flip_token":
        x = F.when(infinite, F.lit(eps_high)).otherwise(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def clean_features(df: DataFrame, features: list[str], eps_high: float = 20.0) -> DataFrame:
    """Infinite flip radii become the cap; any other non-finite value becomes 0."""
    return df.withColumns({f: _clean(f, eps_high) for f in features})


def sequences(df: DataFrame, features: list[str], key: str = "hash_id", label: str = "is_correct",
              eps_high: float = 20.0) -> DataFrame:
    """One row per sample: features in token order, length, and the label of the first token.

    The array is the sample's own token list, so its length is that of one response.
    """
    rows = clean_features(df, features, eps_high)
    step = F.struct(F.col("token_idx"), F.array(*[F.col(f) for f in features]).alias("x"))
    return rows.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(step)), lambda s: s["x"]).alias("features"),
        F.count("*").cast("int").alias("seq_length"),
        F.min_by(label, "token_idx").cast("int").alias("label"),
    )


def padded_sequences(df: DataFrame, features: list[str], length: int = 64, key: str = "hash_id",
                     label: str = "is_correct", eps_high: float = 20.0) -> DataFrame:
    """The first ``length`` steps of every sample, zero padded, with the full length and the label.

    Later tokens are dropped before anything is collected, so a list never holds
    more than ``length`` steps.
    """
    rows = clean_features(df, features, eps_high)
    order = Window.partitionBy(key).orderBy("token_idx")
    head = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= length)
    step = F.struct(F.col("_k"), F.array(*[F.col(f) for f in features]).alias("x"))
    packed = head.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(step)), lambda s: s["x"]).alias("_f"))
    facts = df.groupBy(key).agg(
        F.count("*").cast("int").alias("seq_length"), F.min_by(label, "token_idx").cast("int").alias("label")
    )
    return facts.join(packed, key).select(
        key, pad(F.col("_f"), length, len(features)).alias("features"), "seq_length", "label"
    )


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with mean_<col> and scale_<col>; population std, 1 where it is zero."""
    aggs = []
    for c in cols:
        std = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"scale_{c}")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    """Standardise columns with a fitted one-row table, read as a scalar subquery."""
    fitted = params.select(F.struct(*[F.col(c) for c in params.columns]).alias("p")).scalar()
    return df.withColumn("_p", fitted).withColumns(
        {c: (F.col(c) - F.col(f"_p.mean_{c}")) / F.col(f"_p.scale_{c}") for c in cols}
    ).drop("_p")
