"""Near duplicates among embeddings: int8 tile products with rigorous error bounds.

Each unit vector u is s*c + e with int8 codes c, a scale s and a rest e of known
norm. For two vectors |u.v - s*t*(c.d)| <= |e_u|*|t*d| + |e_v|, so a tile's integer
products settle most pairs; only those that may reach the threshold are computed
in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import stored
from .components import components, forest, tiles

SLACK = 1e-9  # rounding of the bound itself, which is computed in double precision


@pandas_udf(BinaryType())
def packed(vector: pd.Series) -> pd.Series:
    """The components as doubles; null where the vector is null, empty, zero or not finite throughout."""
    out = []
    for v in vector:
        x = None if v is None else np.asarray([np.nan if c is None else c for c in v] if v.dtype == object else v, dtype="<f8")
        good = x is not None and len(x) and np.isfinite(x).all() and x.any()
        out.append((x + 0.0).tobytes() if good else None)  # -0.0 becomes 0.0
    return pd.Series(out, dtype=object)


def _codes(x: np.ndarray):
    # the scale is a power of two: it changes no cosine and keeps squares in range
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    norm = np.sqrt((x * x).sum(1))
    u = x / norm[:, None]
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None])
    rest = np.sqrt(((u - codes * scale[:, None]) ** 2).sum(1))
    # integers up to 127 * 127 * dims are exact in single precision below 2 ** 24
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return x, norm, scale, codes.astype(np.int8).astype(exact), rest, scale * np.sqrt((codes * codes).sum(1))


def _tile(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["_i"].iloc[0] == rows["_j"].iloc[0]
        left = rows if own else rows[rows["_side"] == 0]
        right = left if own else rows[rows["_side"] == 1]
        empty = pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        if not len(left) or not len(right):
            return empty
        unpack = lambda part: np.frombuffer(b"".join(part["key"]), dtype="<f8").reshape(len(part), -1)
        x, nx, sx, cx, ex, qx = _codes(unpack(left))
        y, ny, sy, cy, ey, qy = (x, nx, sx, cx, ex, qx) if own else _codes(unpack(right))
        about = (cx @ cy.T) * sx[:, None] * sy[None, :]
        bound = ex[:, None] * qy[None, :] + ey[None, :]
        i, j = np.nonzero(about + bound >= threshold - SLACK)
        if own:
            i, j = i[i < j], j[i < j]
        cosine = np.concatenate([
            np.einsum("ij,ij->i", x[i[k:k + 65536]], y[j[k:k + 65536]]) / (nx[i[k:k + 65536]] * ny[j[k:k + 65536]])
            for k in range(0, len(i), 65536)
        ] or [np.zeros(0)])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        ln, rn = left["node"].to_numpy(), right["node"].to_numpy()
        lc, rc = left["copies"].to_numpy(), right["copies"].to_numpy()
        nodes = np.concatenate([ln[i], rn[j]])
        links = pd.Series(np.concatenate([rc[j], lc[i]]), index=nodes).groupby(level=0).sum()
        a, b = forest(ln[i], rn[j])
        return pd.DataFrame({
            "a": np.concatenate([links.index.to_numpy(dtype="int64"), a]),
            "b": pd.array([None] * len(links) + list(b), dtype="Int64"),
            "n": np.concatenate([links.to_numpy(dtype="int64"), np.zeros(len(a), "int64")]),
        })

    return work


def near_vectors(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, block_rows: int = 512
) -> DataFrame:
    """Direct links and components of vectors with the same label and cosine >= ``threshold``.

    Returns one row per input row: ``id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable, its own included), ``kept``. Equal
    vectors of a label are compared once and counted as often as they occur. Rows
    with a null label, and vectors that are null, empty, zero or hold a null or
    non-finite component, link with nothing, and so do vectors of unequal length.
    A null id has no component of its own and is never kept.
    """
    rows = stored(
        df.select(F.col(id).alias("id"), F.col(label).alias("label"), F.when(F.col(label).isNotNull(), packed(F.col(vector).cast("array<double>"))).alias("key")),
        "vectors",
    )
    classes = stored(
        rows.where(F.col("key").isNotNull()).groupBy("label", "key").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.octet_length("key")),
        "vectors",
    )
    schema = StructType([StructField(c, LongType()) for c in ("a", "b", "n")])
    laid = tiles(classes, ["label", "dims"], "node", block_rows)
    found = stored(laid.groupBy("label", "dims", "_i", "_j").applyInPandas(_tile(threshold), schema), "tiles")
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = stored(components(found.where(F.col("b").isNotNull()).select("a", "b")), "components")
    placed = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    known = placed.join(least, "root").select(
        F.col("label").alias("_label"), F.col("key").alias("_key"), "component",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    out = rows.join(known, (rows["label"] == known["_label"]) & (rows["key"] == known["_key"]), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
