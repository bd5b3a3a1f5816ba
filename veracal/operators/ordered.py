"""Running aggregates, dense indexes and exact quantiles over any number of rows.

A window over one big group would sort that group in one task. Here rows are range-partitioned by group and order, so a
group may span many tasks. Every task scans its rows once and writes them, below the shared folder, with running values
that are right within the task; the last row of each (task, group) carries that stretch's totals, a window over those few rows gives what each task must add,
and only groups that cross tasks need it: fewer rows than there are partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, IntegralType, LongType, StructField, StructType

from ..session import stored

GROUP = "_group"
_KEYS = ["_g1", "_g2"]


def group_key(by: list[str]) -> Column:
    """One key for all group columns; a struct also matches where a field is null."""
    return F.struct(*by) if by else F.lit(0)


def _group_hashes(by: list[str]) -> list[Column]:
    """128 bits that name a group; which columns are null counts."""
    if not by:
        return [F.lit(0).cast("bigint").alias(k) for k in _KEYS]
    parts = [*[F.col(c) for c in by], *[F.col(c).isNull() for c in by]]
    return [F.xxhash64(*parts, F.lit(salt)).alias(k) for salt, k in enumerate(_KEYS)]


class _Stretch:
    """One batch of a task's rows, cut into runs of one group, with what the run before it left."""

    def __init__(self, batch: pa.RecordBatch, before: _Stretch | None):
        n = batch.num_rows
        keys = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in _KEYS]
        self.n, self.keys = n, tuple(int(k[-1]) for k in keys)
        self.new = np.ones(n, bool)
        self.new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
        self.goes_on = before is not None and before.keys == tuple(int(k[0]) for k in keys)
        self.new[0] = not self.goes_on
        self.run = np.cumsum(self.new)
        at = np.arange(n)
        # first row of the run; -1 where it began in an earlier batch
        self.first = np.maximum.accumulate(np.where(self.new, at, -1))
        self.before = before if self.goes_on else None
        self.count = at - self.first + np.where(self.first < 0, before.count[-1] if self.goes_on else 0, 1)
        self.ends: dict[str, object] = {}

    def sums(self, name: str, values: pa.Array) -> pa.Array:
        values = values.cast(pa.int64() if pa.types.is_integer(values.type) else pa.float64())
        v = np.array(values.fill_null(0).to_numpy(zero_copy_only=False))
        if self.before is not None:
            v[0] += self.before.ends[name]
        out = pd.Series(v).groupby(self.run).cumsum().to_numpy()
        self.ends[name] = out[-1]
        return pa.array(out)

    def lasts(self, name: str, values: pa.Array, inclusive: bool) -> list[pa.Array]:
        """Last non-null value, with the row itself and, if asked for, without it."""
        held = self.before.ends[name] if self.before is not None else pa.nulls(1, values.type)
        pool = pa.concat_arrays([held, values])
        known = values.is_valid().to_numpy(zero_copy_only=False)
        seen = np.maximum.accumulate(np.where(known, np.arange(self.n), -1))
        # rows of the run only; slot 0 of the pool is what the run had before this batch
        place = np.where(seen >= self.first, seen, np.where(self.first < 0, -1, -2))
        with_row = pool.take(pa.array(place + 1, mask=place == -2))
        self.ends[name] = with_row.slice(self.n - 1, 1)
        if inclusive:
            return [with_row]
        shifted = np.concatenate([[-1 if self.goes_on else -2], np.where(self.new[1:], -2, place[:-1])])
        return [with_row, pool.take(pa.array(shifted + 1, mask=shifted == -2))]

    def peaks(self, name: str, values: pa.Array) -> list[pa.Array]:
        """Largest value so far and the row of the run, from 1, that first had it."""
        known = values.is_valid().to_numpy(zero_copy_only=False)
        v = np.where(known, values.fill_null(0.0).to_numpy(zero_copy_only=False), -np.inf)
        held = self.before.ends[name] if self.before is not None else (None, None)
        if held[0] is not None:
            v, known = np.append(held[0], v), np.append(True, known)
            run = np.append(self.run[0], self.run)
        else:
            run = self.run
        skip = len(v) - self.n
        groups = pd.Series(v).groupby(run)
        top = groups.cummax().to_numpy()
        count = pd.Series(known).groupby(run).cumsum().to_numpy()
        fresh = np.ones(len(v), bool)
        fresh[1:] = run[1:] != run[:-1]
        rises = known & ((count == 1) | ~fresh & (v > np.append(-np.inf, top[:-1])))
        spot = np.maximum.accumulate(np.where(rises, np.arange(len(v)), -1))[skip:]
        has = (count > 0)[skip:]
        place = np.where(has, spot, 0)
        row = np.append([held[1] or 0] * skip, self.count)[place]
        top = top[skip:]
        self.ends[name] = (float(top[-1]), int(row[-1])) if has[-1] else (None, None)
        return [pa.array(top, mask=~has), pa.array(row.astype(np.int64), mask=~has)]


def _scanned(laid: DataFrame, width: int, kinds: dict[str, str], inclusive: bool) -> DataFrame:
    """The rows with their task, whether they end a stretch of one group, and running values within the task."""
    types = {f.name: f.dataType for f in laid.schema.fields}
    made = []
    for name, kind in kinds.items():
        of = types[f"_v_{name}"]
        made.append(StructField(f"_l_{name}", (LongType() if isinstance(of, IntegralType) else DoubleType()) if kind == "sum" else of))
        if kind == "peak":
            made.append(StructField(f"_r_{name}", LongType()))
        elif kind == "last" and not inclusive:
            made.append(StructField(f"_x_{name}", of))
    marks = [StructField("_g_task", IntegerType()), StructField("_g_ends", BooleanType()), StructField("_g_count", LongType())]
    schema = StructType([*laid.schema.fields[:width], *[StructField(k, LongType()) for k in _KEYS], *made, *marks])

    def work(batches):
        task, before, waiting = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _Stretch(batch, before)
            if waiting is not None:
                yield _flagged(waiting, np.array([now.new[0]]), schema.names)
            cols = []
            for name, kind in kinds.items():
                values = batch.column(batch.schema.get_field_index(f"_v_{name}"))
                if kind == "sum":
                    cols.append(now.sums(name, values))
                elif kind == "last":
                    cols += now.lasts(name, values, inclusive)
                else:
                    cols += now.peaks(name, values)
            whole = [*batch.columns[: width + len(_KEYS)], *cols, pa.array(np.full(now.n, task, np.int32)), pa.array(now.count)]
            if now.n > 1:
                yield _flagged([c.slice(0, now.n - 1) for c in whole], now.new[1:], schema.names)
            # whether the last row ends its stretch shows with the next batch
            waiting, before = [c.slice(now.n - 1, 1) for c in whole], now
            now.before = None
        if waiting is not None:
            yield _flagged(waiting, np.array([True]), schema.names)

    return laid.mapInArrow(work, schema)


def _flagged(columns: list[pa.Array], ends: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns[:-1], pa.array(ends), columns[-1]], names=names)


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    descending: bool = False,
    inclusive: bool = True,
    totals: bool = False,
) -> DataFrame:
    """Add running aggregates along an order inside each group, for any size of a group.

    ``aggs`` maps an output name to (kind, column) with kind ``sum``, ``last`` (last non-null value) or ``peak`` (largest
    value so far; ``<name>_row`` is the row of the group, from 1, that first had it). ``inclusive`` tells whether a row
    counts in its own last value; sums and peaks count it always. ``totals`` adds ``<name>_total`` for the sums. Nulls of the
    order come first, last if ``descending``; rows of equal order are in any order. Column names that begin with ``_g``,
    ``_l_``, ``_v_``, ``_x_``, ``_r_`` or ``_c_`` are taken.
    """
    width, kinds = len(df.columns), {name: kind for name, (kind, _) in aggs.items()}
    values = [col.cast("double").alias(f"_v_{n}") if kind == "peak" else col.alias(f"_v_{n}") for n, (kind, col) in aggs.items()]
    base = df.select("*", *_group_hashes(by), *values)
    along = [*[F.col(k) for k in _KEYS], *[F.col(c).desc() if descending else F.col(c).asc() for c in order]]
    # written once: ranges are sampled, and both branches below must see the same ones
    scanned = stored(_scanned(base.repartitionByRange(*along).sortWithinPartitions(*along), width, kinds, inclusive), "running")

    ends = scanned.where("_g_ends")
    group = Window.partitionBy(*_KEYS)
    earlier = group.orderBy("_g_task").rowsBetween(Window.unboundedPreceding, -1)
    rows_before = F.coalesce(F.sum("_g_count").over(earlier), F.lit(0))
    counted = ends.select("_g_task", *_KEYS, rows_before.alias("_c_rows"), *[c for c in ends.columns if c[:3] in ("_l_", "_r_")])
    carried = []
    for name, kind in kinds.items():
        if kind == "sum":
            carried.append(F.sum(f"_l_{name}").over(earlier).alias(f"_c_{name}"))
            if totals:
                carried.append(F.sum(f"_l_{name}").over(group).alias(f"_c_total_{name}"))
        elif kind == "last":
            carried.append(F.last(f"_l_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        else:
            first = F.struct(F.col(f"_l_{name}").alias("value"), (-(F.col("_c_rows") + F.col(f"_r_{name}"))).alias("row"))
            carried.append(F.max(F.when(F.col(f"_l_{name}").isNotNull(), first)).over(earlier).alias(f"_c_{name}"))
    keys = ["_g_task", *_KEYS]
    carry = counted.select(*keys, "_c_rows", *carried)
    # at most one row for each task and crossing group; all groups only where totals are asked for
    joined = scanned.join(F.broadcast(carry.where("_c_rows > 0")) if not totals else carry if by else F.broadcast(carry), keys, "left")

    outs = []
    for name, kind in kinds.items():
        local, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            outs.append((local + F.coalesce(before, F.lit(0))).alias(name))
            if totals:
                outs.append(F.col(f"_c_total_{name}").alias(f"{name}_total"))
        elif kind == "last":
            outs.append(F.coalesce(local if inclusive else F.col(f"_x_{name}"), before).alias(name))
        else:
            row = F.coalesce(F.col("_c_rows"), F.lit(0)) + F.col(f"_r_{name}")
            keeps = local.isNull() | (before["value"] >= local)
            outs += [
                F.when(before.isNotNull() & keeps, before["value"]).otherwise(local).alias(name),
                F.when(before.isNotNull() & keeps, -before["row"]).otherwise(row).alias(f"{name}_row"),
            ]
    return joined.select(*df.columns, *outs)


def dense_index(df: DataFrame, order: str, by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """Zero-based position along a unique order column, plus the row count ``n_total``."""
    one = {"_seen": ("sum", F.lit(1).cast("bigint"))}
    counted = running(df, by or [], [order], one, totals=True)
    return counted.select(*df.columns, (F.col("_seen") - 1).alias(name), F.col("_seen_total").alias("n_total"))


def describe(df: DataFrame, col: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, and mean, std (population), min, max and count per group.

    Rows are first merged per distinct value, so neither the group size nor a
    hot value decides how much one task holds, and the input is read once.
    """
    hist = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    v = F.col(col).cast("double")
    ranked = running(hist, by, [col], {"_cum": ("sum", F.col("_n")), "_sum": ("sum", v * F.col("_n"))}, totals=True)
    n = F.col("_cum_total")
    mean = F.col("_sum_total") / n
    picks = []
    for name, p in probs.items():
        h = (n - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (rank < F.col("_cum")) & (rank >= F.col("_cum") - F.col("_n"))
            picks.append(F.max(F.when(inside, v)).alias(f"_{name}_{side}"))
    found = ranked.groupBy(*by).agg(
        F.max(n).alias("count"),
        F.max(mean).alias("mean"),
        F.sqrt(F.sum(F.col("_n") * F.pow(v - mean, 2)) / F.max(n)).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        *picks,
    )
    outs = []
    for name, p in probs.items():
        h = (F.col("count") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return found.select(*by, "count", "mean", "std", "min", "max", *outs)


def quantiles(df: DataFrame, col: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles, one row per group."""
    return describe(df, col, by, probs).select(*by, *probs)


def take_per_group(df: DataFrame, by: list[str], digest: str, quota: str) -> DataFrame:
    """Rows whose position in their group, along a digest, is within the row's quota."""
    ranked = running(df, by, [digest], {"_seen": ("sum", F.lit(1).cast("bigint"))})
    return ranked.where(F.col("_seen") <= F.col(quota)).drop("_seen")
