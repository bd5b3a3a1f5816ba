"""Helpers of the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

LOWEST = -(1 << 63)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared folder and read back.

    Cuts the lineage, and fixes what depends on the run (row ids, draws), so a
    lost executor recomputes from files that all machines see.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """While tables are written inside, Python gets at most so many rows at once; for wide rows that a task holds several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def longs(values) -> Column:
    """A literal array of bigint; for lists whose length a parameter bounds."""
    return F.lit(np.asarray(list(values), dtype=np.int64))


def unit(*cols: Column | str, seed: int = 0) -> Column:
    """A draw in [0, 1) that is a function of the row's values."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(1 << 53))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``, the zero-based position along ``order``, for any number of rows.

    Range partitions are sorted one by one; their counts, one number for each
    partition, shift the positions.
    """
    spark = df.sparkSession
    # the number of partitions is fixed: the row ids below must be dense within each of them
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, seen = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(seen)
        seen += counts.get(p, 0)
    shift = F.get(longs(before), part.cast("int")) if before else F.lit(0)
    return laid.withColumn(name, shift + local).drop("_at")
