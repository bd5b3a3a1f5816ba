"""Split, feature, result and manifest sinks."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import AtomicType, BinaryType, IntegerType, StringType, StructField, StructType

# Fixed value: largest shard of a saved split.
SHARD_BYTES = 250 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row before encoding: lengths of texts and blobs, 16 for other plain values, JSON text of nested ones."""

    def size(field: StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.octet_length(c)
        if isinstance(field.dataType, AtomicType):
            return F.lit(16)
        return F.octet_length(F.to_json(F.struct(c)))

    return sum((F.coalesce(size(f), F.lit(0)).cast("bigint") for f in df.schema.fields), F.lit(0).cast("bigint")) + 16


def write_split(df: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> int:
    """Overwrite a split in shards of at most ``shard_bytes`` measured bytes and return the row count read back.

    A first pass adds up the bytes of every partition, one row each; a second
    counts bytes along a partition and gives its rows file numbers, and one
    exchange by file number writes a file in each task. Only a row that is
    larger than a shard makes a larger file. The order of rows does not matter,
    but a partition must hold the same rows in both passes, else it is an error.
    """
    sized = df.withColumn("_bytes", row_bytes(df))

    def add_up(batches):
        task, total, most = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if batch.num_rows:
                measured = batch.column(batch.num_columns - 1).to_numpy()
                total, most = total + int(measured.sum()), max(most, int(measured.max()))
        yield pa.RecordBatch.from_pydict({"task": [task], "sum": [total], "most": [most]})

    # over whole rows: pruned ones may be dealt to other partitions
    per = sized.mapInArrow(add_up, "task bigint, sum bigint, most bigint").collect()
    # a file may begin just below the limit and end with the longest row
    step = max(1, shard_bytes - max((r["most"] for r in per), default=0))
    first, total = {}, 0
    for r in sorted(per, key=lambda r: r["task"]):
        first[r["task"]] = (total, r["sum"])
        total += -(-r["sum"] // step)
    schema = StructType([*sized.schema.fields, StructField("_file", IntegerType())])

    def number(batches):
        start, expected = first.get(TaskContext.get().partitionId(), (0, 0))
        seen = 0
        for batch in batches:
            before = seen + np.concatenate([[0], np.cumsum(batch.column(batch.num_columns - 1).to_numpy())])
            seen = int(before[-1])
            if seen > expected:
                raise RuntimeError("a partition changed between two passes; store the table first")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((start + before[:-1] // step).astype(np.int32))], names=schema.names)

    files = sized.mapInArrow(number, schema).repartitionById(max(1, total), F.col("_file")).select(*df.columns)
    files.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def save_features(df: DataFrame, path: str, keys: list[str], features: list[str]) -> None:
    """Token features in a fixed column order, columnar and as CSV."""
    ordered = df.select(*keys, *features)
    ordered.write.mode("overwrite").parquet(f"{path}/features.parquet")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/features.csv")


def write_results(records: DataFrame, overall: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Per-sample records and one summary document; the committer publishes whole files only."""
    records.write.mode("overwrite").json(f"{path}/records", compression="gzip")
    # one row per result, so a single small file
    summary = overall.select(
        F.struct("*").alias("overall"),
        F.from_json(F.lit(json.dumps(metadata or {}, default=str)), "map<string,string>").alias("metadata"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def manifest(df: DataFrame, key: str, config: dict, pattern: str) -> DataFrame:
    """One row: count, key range, configuration and key pattern of an output."""
    return df.agg(
        F.count("*").alias("n_samples"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
    ).select(
        "*",
        F.lit(json.dumps(config, sort_keys=True)).alias("config"),
        F.lit(pattern).alias("key_pattern"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
    )
