"""Range sharding with sampled splitters, on DataFrame functions alone.

Rows are ordered by (digest of the text, id, row number), so equal texts lie
next to each other. Splitters are weighted quantiles of a bounded sample of that
order, and a row longer than a range is a range of its own; ranges that turn out
overfull, for instance since one text holds a third of all rows, are sampled again
and cut inside the text, by id. The many small ranges are then strung into shards
of near equal bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWEST, longs, stored, unit

ORDER = ["_key", "_id", "_seq"]
MAX_ROUNDS = 12


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at or before the row: a binary search in arrays of bounded length."""
    if not splitters:
        return F.lit(0)
    keys, ids, seqs = (longs(x) for x in zip(*splitters))
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def step(pos: Column, width: Column) -> Column:
        at = (pos + width - 1).cast("int")
        k, i, s = F.get(keys, at), F.get(ids, at), F.get(seqs, at)
        reached = (k < F.col("_key")) | (
            (k == F.col("_key")) & ((i < F.col("_id")) | ((i == F.col("_id")) & (s <= F.col("_seq"))))
        )
        return pos + F.when(reached, width).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(longs(steps), F.lit(0).cast("bigint"), step).cast("int")


def _splitters(rows: DataFrame, group: list[str], load: Column, share: float, draws: int, seed: int) -> list[tuple]:
    """Quantiles of a sample drawn in proportion to ``load``: one for each ``share`` of it, in each group.

    A row is drawn with probability load * draws / share, at most 1, and stands
    for share / draws of the load, or for its own load if that is larger.
    """
    drawn = rows.where(unit(*ORDER, seed=seed) < load * draws / share).withColumn(
        "_w", F.greatest(load, F.lit(share / draws))
    )
    along = Window.partitionBy(*group).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = drawn.withColumn("_to", F.sum("_w").over(along))
    cut = F.floor(F.col("_to") / share) > F.floor((F.col("_to") - F.col("_w")) / share)
    return [tuple(r) for r in reached.where(cut).select(*ORDER).collect()]


def _around(rows: DataFrame, load: Column, share: float) -> set[tuple]:
    """Splitters at and right after each row that loads a range alone; there are at most 1 / share such rows."""
    alone = [tuple(r) for r in rows.where(load >= share).select(*ORDER).collect()]
    return {*alone, *((k, i, s + 1) for k, i, s in alone)}


def shard_by_size(
    df: DataFrame, text: str = "text", id: str = "doc_id", keep: list[str] | None = None, shards: int = 8,
    ranges_per_shard: int = 256, draws: int = 8,
) -> DataFrame:
    """Put every row into one of ``shards`` ranges whose bytes are nearly equal.

    Returns the ``keep`` columns (default: the id) with ``size`` (UTF-8 bytes of
    the text plus 1), ``text_crc32``, ``shard``, and ``slot``, the gapless
    position within the shard. Sample and splitters are bounded by the two last
    parameters, whatever the input. A null text has size 1 and no checksum, a
    null id sorts first, repeated rows are told apart by a row number, one row
    is never divided. Without rows the result is empty.
    """
    keep = [id] if keep is None else keep
    rows = stored(
        df.select(
            *[F.col(c).alias(f"_keep_{c}") for c in keep],
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("_size"),
            F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
            F.xxhash64(text).alias("_key"),
            F.coalesce(F.col(id).cast("bigint"), F.lit(LOWEST)).alias("_id"),
            F.monotonically_increasing_id().alias("_seq"),
        ),
        "sharding",
    )
    total, count = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    wanted = shards * ranges_per_shard
    # a row loads its range by its bytes and by its place: neither may gather in one task
    load = F.col("_size") / float(max(total, 1)) / 2 + 0.5 / max(count, 1)
    share = 1.0 / wanted
    splitters = sorted(set(_splitters(rows, [], load, share, draws, 0)) | _around(rows, load, share)) if count else []
    for attempt in range(1, MAX_ROUNDS + 1):
        cut = rows.withColumn("_range", _range_of(splitters))
        ranges = cut.groupBy("_range").agg(
            F.sum("_size").alias("bytes"), F.count("*").alias("rows"), F.sum(load).alias("load")
        ).collect()
        over = [r["_range"] for r in ranges if r["load"] > 2 * share and r["rows"] > 1]
        if not over or attempt == MAX_ROUNDS:
            break  # ``ranges`` must be those of the splitters that stay
        inside = cut.where(F.array_contains(longs(over), F.col("_range").cast("bigint")))
        more = _splitters(inside, ["_range"], load, share / 2, draws, attempt)
        grown = sorted({*splitters, *more})
        if len(grown) == len(splitters) and attempt > 3:
            break  # a few rows of more than a range each; no cut helps
        splitters = grown
    by_range = {r["_range"]: r for r in ranges} if count else {}
    shard, first, seen, placed = [], [], 0, [0] * shards
    for r in range(len(splitters) + 1):
        size, n = (by_range[r]["bytes"], by_range[r]["rows"]) if r in by_range else (0, 0)
        s = min(shards - 1, (2 * seen + size) * shards // max(2 * total, 1))
        shard.append(s)
        first.append(placed[s])
        seen, placed[s] = seen + size, placed[s] + n
    at = Window.partitionBy("_range").orderBy(*ORDER)
    return rows.withColumn("_range", _range_of(splitters)).select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.get(longs(shard), F.col("_range")).cast("int").alias("shard"),
        (F.get(longs(first), F.col("_range")) + F.row_number().over(at) - 1).alias("slot"),
    )
