"""Joins between items, model outputs, labels and results.

No side is forced to broadcast: Spark broadcasts a side whose measured size is
below its threshold and otherwise shuffles, splitting hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import GROUP, group_key


class ContractError(ValueError):
    """A table does not have the agreed counts."""


def last_per_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per key, the last along ``order`` (without one: along the other columns); null keys match nothing and go."""
    others = [c for c in df.columns if c != key]
    row = F.struct(*others)
    last = F.max_by(row, F.struct(*order)) if order else F.max(row)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_row")).select(key, "_row.*")


def join_outputs(items: DataFrame, outputs: DataFrame, key: str = "hash_id", order: list[str] | None = None) -> DataFrame:
    """Every output row once with its item columns; outputs without an item are dropped."""
    return outputs.join(last_per_key(items, key, order), key, "inner").withColumn("is_correct", F.col("is_correct").cast("int"))


def join_diagnostics(left: DataFrame, right: DataFrame, key: str = "hash_id") -> DataFrame:
    """Number of distinct keys in both, only left and only right, with the smallest keys of each side."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    placed = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).select(
        key,
        F.when((F.col("l") == 1) & (F.col("r") == 1), F.lit("common"))
        .when(F.col("l") == 1, F.lit("left_only"))
        .otherwise(F.lit("right_only"))
        .alias("side"),
    )
    return placed.groupBy("side").agg(F.count("*").alias("n_keys"), F.min(key).alias("sample_key"))


def only_in(left: DataFrame, right: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Up to n keys that the right side lacks."""
    return left.select(key).join(right.select(key), key, "left_anti").distinct().orderBy(key).limit(n)


def assert_contract(check: DataFrame) -> DataFrame:
    """Fail when any row of a contract check is not ok; returns the check."""
    wrong = check.where(~F.coalesce("ok", F.lit(False)))
    bad = wrong.limit(20).collect()
    if bad:
        more = wrong.count() - len(bad)
        listed = "; ".join(str(r.asDict()) for r in bad) + (f"; and {more} more" if more else "")
        raise ContractError("counts differ from the contract: " + listed)
    return check


def assert_rows(df: DataFrame, expected: int) -> DataFrame:
    actual = df.count()
    if actual != expected:
        raise ContractError(f"expected {expected} rows, found {actual}")
    return df


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Attach a column by key, with a default where the key is unknown."""
    # one row per key, so that repeated rows of the other side never multiply ours
    side = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    return df.join(side, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_coverage(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    found = dim.select(key, F.lit(1).alias("_found")).distinct()
    return df.join(found, key, "left").agg(
        F.count("*").alias("n_rows"), F.count("_found").alias("n_matched")
    )


def question_answers(questions: DataFrame, answers: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions with their reference answers; both texts keep their own name."""
    q = questions.withColumnRenamed("text", "question")
    a = answers.select(key, F.col("text").alias("answer"))
    return q.join(a, key, "inner")


def attach_images(rows: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Rows with their image; rows without one are dropped."""
    return rows.join(images, key, "inner")


def pending(df: DataFrame, done: DataFrame, available: DataFrame | None = None, key: str = "hash_id",
            label: str | None = None) -> DataFrame:
    """Rows still to process: not done, present among the samples, and labelled."""
    out = df.join(done.select(key), key, "left_anti")
    if available is not None:
        ready = available if label is None else available.where(F.col(label).isNotNull())
        out = out.join(ready.select(key), key, "left_semi")
    return out


def override(df: DataFrame, other: DataFrame, key: str, col: str) -> DataFrame:
    """The other table's value wins wherever it has the key, even when null; ``origin`` tells which."""
    side = last_per_key(other.select(key, F.col(col).alias("_other")), key).withColumn("_has", F.lit(True))
    has = F.coalesce("_has", F.lit(False))
    return (
        df.join(side, key, "left")
        .withColumn(
            "origin",
            F.when(has, F.lit("merged")).when(F.col(col).isNotNull(), F.lit("kept")).otherwise(F.lit("missing")),
        )
        .withColumn(col, F.when(has, F.col("_other")).otherwise(F.col(col)))
        .drop("_other", "_has")
    )


def fallback(df: DataFrame, other: DataFrame, key: str, col: str) -> DataFrame:
    """Own value, else the other table's."""
    side = last_per_key(other.select(key, F.col(col).alias("_other")), key)
    return df.join(side, key, "left").withColumn(col, F.coalesce(col, "_other")).drop("_other")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def common_samples(P: DataFrame, by: list[str], unit: str, what: str = "method") -> DataFrame:
    """Rows of the units that every ``what`` of the group has scored."""
    pairs = P.select(*by, unit, what).distinct()
    per_unit = pairs.groupBy(*by, unit).agg(F.count("*").alias("_n"))
    # from one row per (group, value): the number of values every unit has to reach
    per_group = P.select(*by, what).distinct().groupBy(group_key(by).alias(GROUP)).agg(F.count("*").alias("_all"))
    complete = per_unit.withColumn(GROUP, group_key(by)).join(per_group, GROUP).where(F.col("_n") == F.col("_all"))
    full = group_key(by + [unit])
    kept = P.withColumn(GROUP, full).join(complete.select(full.alias(GROUP)), GROUP, "left_semi")
    return kept.drop(GROUP)


def funnel(df: DataFrame, rules: dict[str, Column], rest: str = "ok") -> DataFrame:
    """Rows per status; the first rule that holds decides."""
    status = None
    for name, rule in rules.items():
        hit = F.coalesce(rule, F.lit(False))
        status = F.when(hit, F.lit(name)) if status is None else status.when(hit, F.lit(name))
    return df.groupBy(status.otherwise(F.lit(rest)).alias("status")).agg(F.count("*").alias("n"))
