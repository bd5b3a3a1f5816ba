"""Incremental scoring: new prediction files are taken once, known keys are dropped.

Known keys are state of the stream, in its checkpoint: a batch looks up its own keys and nothing else, so its cost does not
grow with the history (nor does memory, in the RocksDB state store that every run asks for). The scored
rows and the score histogram of every batch are written per batch number, so a replayed batch overwrites itself.
"""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.metrics import metrics_from_histogram, score_histogram

# Rows of a task that wait before repeated keys among them are dropped.
WAITING_ROWS = 200_000

# State on disk; a batch commits its changes, not all files; no second look at every key just to count rows.
_STORE = "spark.sql.streaming.stateStore."
STATE = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _state_settings(spark: SparkSession):
    """While a stream starts, which copies the session's settings, those of its state."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def first_of_batch(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row along ``order`` (nulls last) of every key in a batch; the key must not be null.

    Streams have no sort; rows of one key meet in one task, which holds one row
    for each of its keys in the batch.
    """

    def firsts(waiting: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(waiting)
        table = table.take(pc.sort_indices(table, [(key, "ascending"), *[(c, "ascending") for c in order]]))
        names = table[key].combine_chunks()
        new = pc.not_equal(names.slice(1), names.slice(0, max(0, len(names) - 1)))
        return table.filter(pa.concat_arrays([pa.array([True] * min(1, len(names))), new]))

    def work(batches):
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows > WAITING_ROWS:
                waiting = firsts(waiting).to_batches()
                rows = 0
        if waiting:
            yield from firsts(waiting).to_batches()

    return df.repartition(key).mapInArrow(work, df.schema)


def score_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
                 key: list[str], by: list[str], fmt: str = "parquet", files_per_batch: int | None = None,
                 order: list[str] | None = None) -> StreamingQuery:
    """Start a run over everything that has arrived; ``y`` and ``c`` are the pair columns.

    The first row of a key counts, in a batch along ``order``; null is a key
    value like any other.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    scored = reader.load(source).where(F.col("y").isNotNull() & F.col("c").isNotNull())
    named = scored.withColumn("_id", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    unique = first_of_batch(named, "_id", order or ["c", "y"]).dropDuplicates(["_id"]).drop("_id")

    def take(batch: DataFrame, number: int) -> None:
        place = f"{target}/scored/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        hist = score_histogram(batch.sparkSession.read.parquet(place), by)
        hist.write.mode("overwrite").parquet(f"{target}/histogram/batch={number}")

    writer = unique.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _state_settings(spark):
        return writer.start()


def current_histogram(spark: SparkSession, target: str, by: list[str]) -> DataFrame:
    """Score histogram over all batches so far."""
    return spark.read.parquet(f"{target}/histogram").groupBy(*by, "c").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )


def current_metrics(spark: SparkSession, target: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    return metrics_from_histogram(current_histogram(spark, target, by), by, threshold)
