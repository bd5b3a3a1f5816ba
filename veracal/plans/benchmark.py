"""Benchmark build: sources to one keyed item table, joined with outputs and verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import content_key
from ..operators.curate import dedup_first, ordered_union, require_columns
from ..operators.joins import assert_contract, join_outputs
from ..operators.quality import contract_check

# Columns every item has.
ITEM_COLUMNS = ["question", "answer", "category", "dataset", "hash_id"]


def keyed_items(df: DataFrame, image_key: str, question_key: str = "question") -> DataFrame:
    """Items with their content key; ``question_key`` may name the raw question the key is built on."""
    return df.withColumn(
        "hash_id",
        content_key(F.col("dataset"), F.col("category"), F.col(question_key), F.col("answer"), F.col(image_key)),
    )


def build_items(sources: dict[str, DataFrame], row: str = "row_idx") -> DataFrame:
    """One table in source order with the first copy of every key."""
    for df in sources.values():
        require_columns(df, ITEM_COLUMNS)
    return dedup_first(ordered_union(sources), "hash_id", ["source_rank", row])


def join_and_verify(items: DataFrame, outputs: DataFrame, contract: DataFrame, path: str) -> DataFrame:
    """Join, store, then check the stored table against the contract; fails on any difference."""
    join_outputs(items, outputs).write.mode("overwrite").parquet(path)
    stored = items.sparkSession.read.parquet(path)
    assert_contract(contract_check(stored, contract))
    return stored
