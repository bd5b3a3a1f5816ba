"""Scans of result trees, prediction records, sample arrays, items and paraphrases."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

from ..functions.images import image_size
from ..functions.vectors import token_vector
from ..operators.joins import last_per_key
from ..operators.metrics import METRICS
from ..operators.report import to_long

_BLOCK = "struct<" + ", ".join(f"{m}: double" for m in METRICS) + ">"
RESULT_SCHEMA = f"overall {_BLOCK}, metrics {_BLOCK}, _corrupt string"

# Folder layouts of result trees.
SEEDED = r"/([^/]+)/([^/]+)/seed_(\d+)/[^/]+/test_results\.json$"
UNSEEDED = r"/([^/]+)/([^/]+)/final/test_metrics_and_results\.json$"


def _result_files(spark: SparkSession, root: str) -> DataFrame:
    files = (
        spark.read.schema(RESULT_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.json")
        .json(root)
    )
    block = F.coalesce("overall", "metrics")
    return files.select(F.col("_metadata.file_path").alias("path"), block.alias("block")).where(
        F.col("block").isNotNull()
    )


def read_results(spark: SparkSession, root: str, pattern: str = SEEDED,
                 keys: tuple[str, ...] = ("method", "vlm", "seed")) -> DataFrame:
    """(keys.., metric, value) of every result file whose path matches; keys come from the path.

    Unreadable files and files without a metric block are skipped.
    """
    files = _result_files(spark, root).where(F.col("path").rlike(pattern))
    found = [F.regexp_extract("path", pattern, i + 1) for i in range(len(keys))]
    typed = [(c.cast("int") if k == "seed" else c).alias(k) for k, c in zip(keys, found)]
    return to_long(files.select(*typed, "block.*"), list(keys))


def read_main_results(spark: SparkSession, root: str, seeded: str = SEEDED, unseeded: str = UNSEEDED) -> DataFrame:
    """Seeded results, and unseeded ones (null seed) for the models that have no seeded run."""
    runs = read_results(spark, root, seeded)
    single = read_results(spark, root, unseeded, ("method", "vlm")).withColumn("seed", F.lit(None).cast("int"))
    rest = single.join(runs.select("method", "vlm").distinct(), ["method", "vlm"], "left_anti")
    return runs.unionByName(rest)


def read_variants(spark: SparkSession, root: str, full_root: str, full_name: str, key: str = "variant") -> DataFrame:
    """{variant}/{vlm}/seed_* results plus the full method's own runs under another name."""
    nested = read_results(spark, root, SEEDED, (key, "vlm", "seed"))
    full = read_results(spark, full_root, SEEDED, (key, "vlm", "seed")).withColumn(key, F.lit(full_name))
    return nested.unionByName(full)


_RECORD = (
    "sample_id string, dataset string, confidence_score double, confidence double, "
    "ground_truth_correctness string, label string"
)


def _label(text: Column) -> Column:
    return F.when(F.lower(text).isin("true", "false"), (F.lower(text) == "true").cast("int")).otherwise(
        text.try_cast("double").cast("int")
    )


def read_predictions(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(sample_id, dataset, c, y) from a list, a {"samples": [..]} document or JSON lines, gzipped or not.

    Rows without a confidence or a label are dropped. A multi-line document is
    read by one task per file; large tables belong in JSON lines.
    """
    record = f"struct<{_RECORD}>"
    raw = spark.read.schema(f"{_RECORD}, samples array<{record}>").option("multiLine", multiline).json(path)
    own = F.array(F.struct("sample_id", "dataset", "confidence_score", "confidence", "ground_truth_correctness", "label"))
    rows = raw.select(F.inline(F.coalesce(F.col("samples"), own.cast(f"array<{record}>"))))
    return rows.select(
        "sample_id",
        "dataset",
        F.coalesce("confidence_score", "confidence").alias("c"),
        F.coalesce(_label(F.col("ground_truth_correctness")), _label(F.col("label"))).alias("y"),
    ).na.drop(subset=["c", "y"])


def read_samples(df: DataFrame, vector: str, key: str = "hash_id", label: str = "is_correct") -> DataFrame:
    """(key, vector, label) of labelled samples; ``vector`` is first, last or a column name."""
    vec = token_vector(F.col("hidden_states"), vector) if vector in ("first", "last") else F.col(vector)
    return df.where(F.col(label).isNotNull()).select(
        key, vec.alias("vector"), F.col(label).cast("int").alias("label")
    )


def sample_counts(df: DataFrame, label: str = "is_correct", error: str | None = None) -> DataFrame:
    """Rows used, skipped without a label, and unreadable."""
    bad = F.col(error).isNotNull() if error else F.lit(False)
    return df.agg(
        F.coalesce(F.sum((~bad & F.col(label).isNotNull()).cast("bigint")), F.lit(0)).alias("n_used"),
        F.coalesce(F.sum((~bad & F.col(label).isNull()).cast("bigint")), F.lit(0)).alias("n_unlabelled"),
        F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias("n_unreadable"),
    )


def read_npz(spark: SparkSession, path: str, vector: str = "hidden_states", label: str = "is_correct") -> DataFrame:
    """One-off ingest of one-file-per-sample archives: (hash_id, vectors [T, D], is_correct, error).

    Objects are never unpickled: a label stored as one reads as null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                name = file.rsplit("/", 1)[-1][: -len(".npz")]
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as data:
                        try:
                            mark = data[label].item()
                        except (KeyError, ValueError):
                            mark = None
                        states = np.atleast_2d(data[vector].astype(np.float32))
                        rows.append((name, [list(map(float, r)) for r in states], None if mark is None else int(mark), None))
                except Exception as problem:
                    rows.append((name, None, None, type(problem).__name__))
            out = pd.DataFrame(rows, columns=["hash_id", vector, label, "error"])
            out[label] = out[label].astype("Int64")
            yield out

    return files.select("path", "content").mapInPandas(
        parse, f"hash_id string, {vector} array<array<float>>, {label} bigint, error string"
    )


def line_ends_open(line: str) -> bool:
    """Whether a tab-separated line, begun outside quotes, ends inside a quoted field.

    A field is quoted if it begins with a quote; two quotes inside it stand for one.
    """
    inside = False
    for part in line.split("\t"):
        if inside:
            inside = part.count('"') % 2 == 0
        elif part.startswith('"'):
            inside = part.count('"') % 2 == 1
    return inside


@F.pandas_udf(BooleanType())
def _ends_open(lines: pd.Series) -> pd.Series:
    return lines.map(line_ends_open, na_action="ignore").astype("boolean")


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, multiline: bool | None = None) -> DataFrame:
    """Header TSV; text columns, base64 blobs included, stay strings.

    Files are split over tasks if no record spans lines. Unless ``multiline``
    says so, one pass over the lines proves it: if no line ends inside a quoted
    field, every line is a record. Otherwise a file is read by one task.
    """
    if multiline is None:
        lines = spark.read.text(path)
        quoted = lines.where(F.contains("value", F.lit('"'))).select(_ends_open("value").alias("open"))
        multiline = not quoted.where("open").isEmpty()
    reader = spark.read.option("header", True).option("sep", "\t").option("multiLine", multiline).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def image_dims(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, ok) of an image folder; unreadable files keep a row with ok = false."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return blob_dims(files.select("path", "content"), "content").drop("content")


def blob_dims(df: DataFrame, content: str) -> DataFrame:
    """The same from a column of image files, by their headers; a width, height or ok of the input is replaced."""
    kept = [c for c in df.columns if c not in ("width", "height", "ok")]
    sized = df.withColumn("_s", image_size(F.col(content)))
    return sized.select(
        *kept, F.col("_s.width").alias("width"), F.col("_s.height").alias("height"), F.col("_s.width").isNotNull().alias("ok"),
    )


PARAPHRASE_SCHEMA = (
    "hash_id string, question string, paraphrases array<string>, num_paraphrases int, "
    "raw_response string, timestamp string, metadata map<string,string>"
)


def read_paraphrases(spark: SparkSession, path: str) -> DataFrame:
    """Per-sample paraphrase records; the file name is the key where the record has none."""
    raw = spark.read.schema(PARAPHRASE_SCHEMA).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.json$", 1)
    return raw.withColumn("hash_id", F.coalesce("hash_id", name))


def read_paraphrase_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(hash_id, value) of one JSON object; values stay JSON text."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("hash_id", "value"))


def _first_of(value: Column) -> Column:
    record = F.from_json(value, "paraphrases array<string>")["paraphrases"]
    listed = F.from_json(value, "array<string>")
    return (
        F.when(value.startswith("{"), F.try_element_at(record, F.lit(1)))
        .when(value.startswith("["), F.try_element_at(listed, F.lit(1)))
        .otherwise(value)
    )


def first_paraphrase(items: DataFrame, primary: DataFrame, secondary: DataFrame, mapping: DataFrame,
                     key: str = "hash_id") -> DataFrame:
    """First paraphrase of an item: its record, else the record in the second place, else the mapping.

    Items keep their number of rows: of repeated keys in one place one counts, a first paraphrase before none.
    """

    def head(df: DataFrame, name: str) -> DataFrame:
        return last_per_key(df.select(key, F.try_element_at("paraphrases", F.lit(1)).alias(name)), key)

    return (
        items.join(head(primary, "_a"), key, "left")
        .join(head(secondary, "_b"), key, "left")
        .join(last_per_key(mapping.select(key, _first_of(F.col("value")).alias("_c")), key), key, "left")
        .withColumn("paraphrase", F.coalesce("_a", "_b", "_c"))
        .drop("_a", "_b", "_c")
    )


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """(level, split, model, source, expected) of a count contract file."""
    from ..operators.quality import contract_rows

    return spark.read.text(path, wholetext=True).select(F.inline(contract_rows(F.col("value"))))
