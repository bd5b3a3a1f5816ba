"""Item tables: unions, order-aware deduplication, exact strata, top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import GROUP, dense_index, group_key, running, take_per_group


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def labelled(df: DataFrame, col: str = "is_correct") -> DataFrame:
    """Rows with a label, as an integer."""
    return df.where(F.col(col).isNotNull()).withColumn(col, F.col(col).cast("int"))


def keep_categories(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    return df.where(F.col(col).isin(categories))


def ordered_union(named: dict[str, DataFrame]) -> DataFrame:
    """Sources one after the other, each row tagged with its source and rank."""
    parts = [
        df.withColumns({"source_name": F.lit(name), "source_rank": F.lit(rank)})
        for rank, (name, df) in enumerate(named.items())
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key in the given order. Copies combine on the map side, so a hot key stays small."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(row, F.struct(*order)).alias("_row")
    ).select("_row.*")


def overlap(df: DataFrame, key: str, split: str, splits: list[str]) -> DataFrame:
    """Number of keys shared by each pair of splits."""
    flags = df.groupBy(key).agg(
        *[F.max((F.col(split) == s).cast("int")).alias(f"_s{i}") for i, s in enumerate(splits)]
    )
    pairs = [(i, j) for i in range(len(splits)) for j in range(i + 1, len(splits))]
    counted = flags.agg(
        *[F.coalesce(F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")), F.lit(0)).alias(f"_p{i}_{j}") for i, j in pairs]
    )
    rows = F.array(
        *[
            F.struct(F.lit(splits[i]).alias("left_split"), F.lit(splits[j]).alias("right_split"),
                     F.col(f"_p{i}_{j}").alias("n_shared"))
            for i, j in pairs
        ]
    )
    return counted.select(F.inline(rows))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(key).subtract(b.select(key))


def drop_rare(df: DataFrame, col: str, least: int = 2) -> DataFrame:
    """Rows of classes with at least ``least`` rows; null classes go first."""
    common = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(common.select(col), col, "left_semi")


def class_quotas(df: DataFrame, col: str, size: int, least: int = 2) -> DataFrame:
    """Class sizes and whole-number quotas that sum to ``size`` (largest remainder, then class name)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = counts.agg(F.sum("n").alias("t")).scalar()
    share = F.lit(size).cast("bigint") * F.col("n")
    base = counts.withColumn("_t", total).select(
        col, "n", "_t", share.alias("_share")
    ).select(
        col, "n", "_t",
        F.expr("_share div _t").alias("_base"),
        (-F.expr("_share % _t")).alias("_rest"),
    )
    left = F.lit(size).cast("bigint") - base.agg(F.sum("_base").alias("s")).scalar()
    ranked = running(
        base, [], ["_rest", col], {"_pos": ("sum", F.lit(1).cast("bigint"))}
    ).withColumn("_left", left)
    quota = F.col("_base") + (F.col("_pos") <= F.col("_left")).cast("bigint")
    return ranked.select(
        col, "n", F.when(F.col("_t") <= size, F.col("n")).otherwise(quota).alias("quota")
    )


def stratified_exact(df: DataFrame, col: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows with proportional classes, or all rows when there are not more.

    Rows are picked by a seeded digest of their key, so the choice is repeatable
    and no class is sorted in one task.
    """
    quotas = class_quotas(df, col, size).select(col, F.col("quota").alias("_quota"))
    joined = df.join(quotas, col).withColumn("_digest", F.md5(F.concat(F.lit(f"{seed}_"), F.col(key).cast("string"))))
    return take_per_group(joined, [col], "_digest", "_quota").select(*df.columns)


def slice_rows(df: DataFrame, start: int, end: int | None, order: str, limit: int | None = None) -> DataFrame:
    """Rows at positions [start, end) of an order, then the first ``limit`` of them."""
    stop = end
    if limit is not None:
        stop = start + limit if end is None else min(end, start + limit)
    placed = dense_index(df, order)
    cond = F.col("idx") >= start
    if stop is not None:
        cond = cond & (F.col("idx") < stop)
    return placed.where(cond).drop("n_total")


def balanced_shards(df: DataFrame, n: int, order: str) -> DataFrame:
    """Shard number per row; shard i holds positions [floor(N*i/n), floor(N*(i+1)/n))."""
    placed = dense_index(df, order)
    shard = F.expr(f"((idx + 1) * {n} + n_total - 1) div n_total - 1").cast("int")
    return placed.withColumn("shard", shard).drop("n_total")


def value_counts(df: DataFrame, col: str, top: int, by: list[str] | None = None) -> DataFrame:
    """Most frequent values with their share; per group when ``by`` is given (a top-k report)."""
    counts = df.groupBy(*(by or []), col).agg(F.count("*").alias("n"))
    if not by:
        total = df.agg(F.count("*").alias("t")).scalar()
        return counts.orderBy(F.desc("n"), col).limit(top).withColumn("pct", F.lit(100.0) * F.col("n") / total)
    # one row per (group, value); the rank filter is pushed below the shuffle
    totals = counts.groupBy(group_key(by).alias(GROUP)).agg(F.sum("n").alias("_t"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), col)
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.withColumn(GROUP, group_key(by)).join(totals, GROUP).select(*by, col, "n", "rank", (F.lit(100.0) * F.col("n") / F.col("_t")).alias("pct"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def display_order(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Rows sorted by the position of their value in a fixed list; ``position`` is one-based."""
    listed = F.array(*[F.lit(x) for x in order])
    return df.withColumn("position", F.array_position(listed, F.col(col)).cast("int")).orderBy("position")


def best_trial(df: DataFrame, score: str = "score", trial: str = "trial", by: list[str] | None = None) -> DataFrame:
    """Trial with the largest finite score; the first trial name wins a tie."""
    finite = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) != float("inf")))
    per_trial = finite.groupBy(*(by or []), trial).agg(F.max(score).alias(score))
    top = per_trial.groupBy(group_key(by or []).alias(GROUP)).agg(F.max(score).alias("_top"))
    tied = per_trial.withColumn(GROUP, group_key(by or [])).join(top, GROUP).where(F.col(score) == F.col("_top"))
    return tied.groupBy(*(by or []), score).agg(F.min(trial).alias(trial))
