"""Exact top-k inner products with segment statistics of rising resolution.

Vectors are cut into 1, 2, 4, ... segments. With means m and deviations s of a
segment of length l, the squared distance is at least the sum of
l * ((m - m')**2 + (s - s')**2), and the inner product is half of
|a|**2 + |b|**2 - distance**2. Candidates whose bound stays below the k-th best
score drop out level by level; the score itself is computed for the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored

RESULT = StructType([StructField(c, LongType()) for c in ("_q", "query_id", "_c", "vec_id", "score")])


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """Per level, sqrt(l) * mean and sqrt(l) * deviation of each segment, so that distances of these rows bound distances."""
    out, parts = [], 1
    while parts <= max(1, x.shape[1] // 4):
        cut = np.linspace(0, x.shape[1], parts + 1).astype(int)
        stats = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            seg = x[:, lo:hi]
            stats += [seg.mean(1) * np.sqrt(hi - lo), seg.std(1) * np.sqrt(hi - lo)]
        out.append(np.stack(stats, 1))
        parts *= 2
    return out


def _exact(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    top = max(np.abs(c).max(initial=0), np.abs(q).max(initial=0))
    if c.shape[1] * top * top < float(1 << 53):
        return (c @ q).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(row, q)) for row in c]
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in whole], dtype=np.int64)


def _search(k: int, seeds: int):
    def work(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(cands) and len(queries):
            for dims, q in queries.groupby(queries["vector"].map(len)):
                c = cands[cands["vector"].map(len) == dims]
                if len(c):
                    found += _block(c, q, k, seeds)
        flat = [np.concatenate(x) for x in zip(*found)] if found else [[]] * 5
        out = pd.DataFrame(dict(zip(RESULT.names, flat)))
        return out.astype({n: "Int64" for n in RESULT.names})

    return work


def _block(c: pd.DataFrame, q: pd.DataFrame, k: int, seeds: int) -> list:
    with np.errstate(all="ignore"):
        cx, qx = np.stack(c["vector"].to_numpy()), np.stack(q["vector"].to_numpy())
        cl, ql = _levels(cx), _levels(qx)
        cn, qn = (cx * cx).sum(1), (qx * qx).sum(1)
        rows, ids = c["row"].to_numpy(), c["id"].astype("Int64")
        place = ids.fillna((1 << 63) - 1).to_numpy(dtype=np.int64)
        found = []
        for i in range(len(q)):
            alive = np.nonzero(rows != q["row"].iloc[i])[0]
            bound = lambda at, level: (cn[at] + qn[i] - ((cl[level][at] - ql[level][i]) ** 2).sum(1)) / 2
            if len(alive) > seeds:
                first = bound(alive, min(2, len(cl) - 1))
                some = alive[np.argpartition(-first, seeds)[:seeds]]
                least = np.partition(_exact(cx[some], qx[i]), -k)[-k] if seeds >= k else -np.inf
                for level in range(len(cl)):
                    slack = 1e-9 * (cn[alive] + qn[i]) + 1e-6
                    # a bound that is not a number keeps its candidate
                    alive = alive[~(bound(alive, level) + slack < least)]
            score = _exact(cx[alive], qx[i])
            best = np.lexsort((rows[alive], place[alive], -score.astype(object) if (score == -(1 << 63)).any() else -score))[:k]
            n = len(best)
            found.append((
                np.full(n, q["row"].iloc[i]), pd.array([q["id"].iloc[i]] * n, dtype="Int64"), rows[alive][best],
                ids.iloc[alive[best]].array, score[best],
            ))
    return found


def exact_topk(
    df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, seeds: int = 64,
    block_rows: int = 4096, block_queries: int = 512,
) -> DataFrame:
    """The k highest integer inner products of every query row against every other row.

    Components become floor(256 * x) in double precision. Returns ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller id, a null id
    comes last. Vectors that are null, empty, or hold a null or non-finite component
    take no part; vectors of another length are no candidates; a repeated id is a
    row of its own. Scores beyond 64 bits stop at the limit of the type.

    Queries and rows meet in tiles of ``block_queries`` by ``block_rows``.
    """
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = stored(
        df.where(usable).select(
            F.col(id).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256.0).cast("double")).alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row"),
        ),
        "topk",
    )
    n, n_queries = rows.agg(F.count("*"), F.sum(F.col("is_query").cast("bigint"))).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-(n_queries or 0) // block_queries))
    part = lambda count, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    cands = rows.select("id", "vector", "row", part(blocks, 1).alias("_i"), every(query_blocks).alias("_j"))
    queries = rows.where("is_query").select("id", "vector", "row", part(query_blocks, 2).alias("_j"), every(blocks).alias("_i"))
    found = cands.groupBy("_i", "_j").cogroup(queries.groupBy("_i", "_j")).applyInPandas(_search(k, seeds), RESULT)
    best = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "_c")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
