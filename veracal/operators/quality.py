"""Data-quality checks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binning import linear_bin
from ..functions.keys import has_text
from ..functions.vectors import is_nonfinite
from .ordered import describe, quantiles, running


def blank_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null or blank values per column."""
    blank = df.agg(
        *[
            F.sum((~has_text(F.col(c).cast("string"))).cast("bigint")).alias(c)
            for c in cols
        ]
    )
    return blank.unpivot([], cols, "field", "n_blank")


def uniqueness(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Total, unique and surplus keys per group."""
    per_key = df.groupBy(*by, key).agg(F.count("*").alias("_n"))
    return per_key.groupBy(*by).agg(
        F.sum("_n").alias("total"), F.count("*").alias("n_unique"), (F.sum("_n") - F.count("*")).alias("duplicates")
    )


def name_sets(df: DataFrame, col: str, by: list[str], expected: dict[str, Column] | None = None) -> DataFrame:
    """Sorted distinct names per group."""
    names = df.where(F.col(col).isNotNull()).select(*by, col).distinct()
    out = names.groupBy(*by).agg(
        F.count("*").alias("n_names"), F.array_join(F.sort_array(F.collect_list(col)), ",").alias("names")
    )
    for name, rule in (expected or {}).items():
        out = out.withColumn(name, rule)
    return out


def contract_rows(contract: Column) -> Column:
    """Contract JSON text to an array of (level, split, model, source, expected)."""
    schema = (
        "splits map<string, map<string, bigint>>, per_source map<string, map<string, bigint>>, "
        "per_split_model map<string, map<string, bigint>>, "
        "per_split_model_source map<string, map<string, map<string, bigint>>>, "
        "per_split_model_correctness map<string, map<string, bigint>>"
    )
    parsed = F.from_json(contract, schema)

    def row(level: Column, split: Column, model: Column, source: Column, n: Column) -> Column:
        return F.struct(
            level.alias("level"), split.alias("split"), model.alias("model"), source.alias("source"),
            n.alias("expected"),
        )

    none = F.lit("")

    def two(field: str, build) -> Column:
        outer = F.map_entries(F.coalesce(parsed[field], F.from_json(F.lit("{}"), "map<string, map<string, bigint>>")))
        return F.flatten(
            F.transform(outer, lambda o: F.transform(F.map_entries(o["value"]), lambda i: build(o["key"], i)))
        )

    splits = two("splits", lambda s, e: row(e["key"], s, none, none, e["value"]))
    source = two("per_source", lambda s, e: row(F.lit("source_unique"), s, none, e["key"], e["value"]))
    model = two("per_split_model", lambda s, e: row(F.lit("model_rows"), s, e["key"], none, e["value"]))
    correct = two("per_split_model_correctness", lambda s, e: row(F.lit("model_correct"), s, e["key"], none, e["value"]))
    deep_type = "map<string, map<string, map<string, bigint>>>"
    deep = F.map_entries(F.coalesce(parsed["per_split_model_source"], F.from_json(F.lit("{}"), deep_type)))
    cells = F.flatten(
        F.flatten(
            F.transform(
                deep,
                lambda s: F.transform(
                    F.map_entries(s["value"]),
                    lambda m: F.transform(
                        F.map_entries(m["value"]),
                        lambda e: row(F.lit("model_source_rows"), s["key"], m["key"], e["key"], e["value"]),
                    ),
                ),
            )
        )
    )
    return F.concat(splits, source, model, correct, cells)


def actual_counts(df: DataFrame, key: str = "hash_id", order: list[str] | None = None) -> DataFrame:
    """Counts of a joined table at every contract level: (level, split, model, source, actual)."""
    cells = df.groupBy("split", "model_name", "dataset").agg(
        F.count("*").alias("rows"), F.sum(F.col("is_correct").cast("bigint")).alias("correct")
    )
    first = F.min_by("dataset", F.struct(*order)) if order else F.min("dataset")
    keys = df.groupBy("split", key).agg(first.alias("dataset")).groupBy("split", "dataset").agg(
        F.count("*").alias("keys")
    )
    none = F.lit("")

    def level(source: DataFrame, name: str, value: Column, model: bool = False, dataset: bool = False) -> DataFrame:
        cols = [F.col("split")] + ([F.col("model_name")] if model else []) + ([F.col("dataset")] if dataset else [])
        return source.groupBy(*cols).agg(value.alias("actual")).select(
            F.lit(name).alias("level"),
            "split",
            (F.col("model_name") if model else none).alias("model"),
            (F.col("dataset") if dataset else none).alias("source"),
            "actual",
        )

    parts = [
        level(cells, "n_rows", F.sum("rows")),
        level(keys, "unique_hash_ids", F.sum("keys")),
        level(keys, "source_unique", F.sum("keys"), dataset=True),
        level(cells, "model_rows", F.sum("rows"), model=True),
        level(cells, "model_correct", F.sum("correct"), model=True),
        level(cells, "model_source_rows", F.sum("rows"), model=True, dataset=True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contract_check(df: DataFrame, contract: DataFrame, key: str = "hash_id",
                   order: list[str] | None = None) -> DataFrame:
    """Actual against expected counts; only levels and cells named by the contract are checked."""
    actual = actual_counts(df, key, order)
    keys = ["level", "split", "model", "source"]
    return contract.join(actual, keys, "left").select(
        *keys,
        F.coalesce("actual", F.lit(0)).alias("actual"),
        "expected",
        (F.coalesce("actual", F.lit(0)) == F.col("expected")).alias("ok"),
    )


def summary(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Mean, exact median and quartiles, population std, min and max per group."""
    cuts = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    return describe(df, col, by, cuts).drop("count")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the range of the column, with the 95th-percentile display limit."""
    facts = describe(df, col, [], {"p95": 0.95}).select(
        F.struct(F.col("min").cast("double").alias("lo"), F.col("max").cast("double").alias("hi"), "p95").alias("f")
    )
    # one row per distinct value is enough to count bins
    ranged = df.groupBy(F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_f", facts.scalar())
    low, high = F.col("_f.lo"), F.col("_f.hi")
    binned = ranged.groupBy(linear_bin(F.col("_v"), low, high, bins).alias("bin")).agg(
        F.sum("_n").alias("n"), F.first("_f").alias("_f")
    )
    start = low + F.col("bin") * ((high - low) / bins)
    return binned.where(F.col("bin").isNotNull()).select(
        "bin", start.alias("low_edge"), "n", (start <= F.col("_f.p95") * 1.1).alias("shown")
    )


def clipped_histogram(df: DataFrame, col: str, by: list[str], p: float = 0.99, n: int = 50) -> DataFrame:
    """Bins between n edges from 0 to a global quantile; larger values are left out of the plot data."""
    top = quantiles(df, col, [], {"cut": p}).scalar()
    cut = df.select(*by, F.col(col).cast("double").alias("_v")).withColumn("_hi", top)
    return (
        cut.where((F.col("_v") >= 0) & (F.col("_v") <= F.col("_hi")))
        .groupBy(*by, linear_bin(F.col("_v"), F.lit(0.0), F.col("_hi"), n - 1).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def runs(df: DataFrame, col: str, index: str) -> DataFrame:
    """Runs of equal values along a dense row index: (value, start, end, n).

    Null values never start or break a run. A run reaches to the row before the
    next run, or to the last row.
    """
    seen = running(df.select(index, col), [], [index], {"_prev": ("last", F.col(col))}, inclusive=False)
    starts = seen.where(
        F.col(col).isNotNull() & (F.col("_prev").isNull() | (F.col(col) != F.col("_prev")))
    ).select(F.col(col).alias("value"), F.col(index).alias("start"))
    following = running(
        starts, [], ["start"], {"_next": ("last", F.col("start"))},
        descending=True, inclusive=False,
    )
    final = df.agg(F.max(index).alias("m")).scalar()
    end = F.coalesce(F.col("_next") - 1, F.col("_last"))
    return following.withColumn("_last", final).select(
        "value", "start", end.alias("end"), (end - F.col("start") + 1).alias("n")
    )


def size_profile(df: DataFrame, by: list[str], patch: int = 196, large: int = 4096 * 4096) -> DataFrame:
    """Width, height, pixel and token profile per group, with the number of very large images."""
    w, h = F.col("width"), F.col("height")
    px = w.cast("bigint") * h
    sized = df.where(w.isNotNull() & h.isNotNull()).withColumns({"pixels": px})
    sized = sized.withColumn("tokens", F.floor(F.col("pixels") / patch).cast("bigint"))
    aggs = []
    for c in ("width", "height", "pixels", "tokens"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return sized.groupBy(*by).agg(
        F.count("*").alias("n"), *aggs, F.sum((F.col("pixels") > large).cast("bigint")).alias("n_large")
    )


def size_alerts(df: DataFrame, by: list[str], mp: float = 10.0) -> DataFrame:
    """Megapixel and token summary, largest first, with a flag above the limit."""
    prof = size_profile(df, by)
    million = F.lit(1e6)
    return prof.select(
        *by,
        "n",
        (F.col("pixels_mean") / million).alias("mean_mp"),
        (F.col("pixels_max") / million).alias("max_mp"),
        (F.col("pixels_min") / million).alias("min_mp"),
        F.col("tokens_mean").alias("mean_tokens"),
        F.col("tokens_max").alias("max_tokens"),
        (F.col("pixels_max") / million > mp).alias("alert"),
    ).orderBy(F.desc("max_mp"), *by)


def label_completeness(df: DataFrame, col: str = "is_correct", by: list[str] | None = None) -> DataFrame:
    done = F.sum(F.col(col).isNotNull().cast("bigint"))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), done.alias("labelled"), (F.count("*") - done).alias("unlabelled")
    )


def unlabelled(df: DataFrame, key: str, col: str = "is_correct") -> DataFrame:
    return df.where(F.col(col).isNull()).select(key)


def paraphrase_status(df: DataFrame, n: int, allow_fewer: bool = False, col: str = "paraphrases") -> DataFrame:
    """Rows per status: created, missing, incorrect_count."""
    k = F.coalesce(F.size(col), F.lit(-1))
    good = (k > 0) if allow_fewer else (k == n)
    status = F.when(k <= 0, F.lit("missing")).when(good, F.lit("created")).otherwise(F.lit("incorrect_count"))
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def paraphrase_completeness(df: DataFrame, n: int, col: str = "paraphrases") -> DataFrame:
    """Rows that have enough, too few or no paraphrase list."""
    k = F.size(col)
    status = (
        F.when(F.col(col).isNull(), F.lit("invalid")).when(k < n, F.lit("incomplete")).otherwise(F.lit("valid"))
    )
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def view_sanity(df: DataFrame, by: list[str], cosine: str, mask: str, base: str, view: str) -> DataFrame:
    """Mask rate, cosine spread and vector lengths of a view; flagged when it looks broken."""
    cos = F.nanvl(F.col(cosine), F.lit(None).cast("double"))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col(mask) == 1).cast("double")).alias("mask_rate"),
        F.avg(cos).alias("cos_mean"),
        F.stddev_pop(cos).alias("cos_std"),
        F.min(cos).alias("cos_min"),
        F.max(cos).alias("cos_max"),
        # lengths, not vectors: a handful of distinct integers
        F.array_join(F.sort_array(F.collect_set(F.size(base))), ",").alias("base_sizes"),
        F.array_join(F.sort_array(F.collect_set(F.size(view))), ",").alias("view_sizes"),
    )
    return out.withColumn("flag", (F.col("mask_rate") < 0.99) | (F.col("base_sizes") != F.col("view_sizes")))


def nonfinite(df: DataFrame, vec: str) -> DataFrame:
    """NaN and infinite cells of a vector column, and the rows that hold any."""
    v = F.col(vec)
    nan = F.size(F.filter(v, lambda x: F.isnan(x)))
    inf = F.size(F.filter(v, lambda x: F.abs(x) == F.lit(float("inf"))))
    return df.select(nan.cast("bigint").alias("nan"), inf.cast("bigint").alias("inf")).agg(
        F.sum("nan").alias("n_nan"),
        F.sum("inf").alias("n_inf"),
        F.sum(((F.col("nan") + F.col("inf")) > 0).cast("bigint")).alias("n_rows"),
    )


def missing_cells(df: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Cells of the expected grid that have no row. The grid is spelled out from the given lists."""
    grid = df.sparkSession.range(1).drop("id")
    for name, values in dims.items():
        kind = df.schema[name].dataType
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    return grid.join(df.select(*dims).distinct(), list(dims), "left_anti")


def image_presence(df: DataFrame, by: list[str], col: str = "image") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count(col).alias("n_images"), (F.count(col) == F.count("*")).alias("ok")
    )


def has_nonfinite(vec: Column) -> Column:
    return F.exists(vec, is_nonfinite)
