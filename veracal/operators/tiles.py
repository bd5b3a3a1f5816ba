"""Products with a matrix table of any size: its row blocks stream past groups of vectors.

The matrix is stored as row blocks. Vectors are dealt into groups that fit a task, every group gets a copy of the blocks
behind its vectors, once for each pass over the matrix, and one sort inside the partition puts them in order. A task
holds its vectors and one block; the driver sees two numbers, the matrix's last row and its width.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import stored

# Bytes of one block, and of what a task holds for one group of vectors.
TILE_BYTES = 1 << 20
GROUP_BYTES = 128 << 20
# Times that a task holds a vector besides what its fold counts: as Arrow rows, those put together, and as rows that leave.
COPIES = 3
# Cells that one group computes in a pass, so that a wide matrix is spread over more tasks.
GROUP_CELLS = 1 << 36
# Cells of a product that are held at once.
CELLS = 1 << 20


class Fold:
    """What a pass over the matrix adds up for a group of vectors.

    ``vectors`` maps a column to its doubles, one row a vector, and to whether each is present; ``columns`` holds further
    columns as Arrow arrays. ``tile`` gets consecutive rows of the matrix, ``between`` runs after each pass, ``result``
    gives the new columns.
    """

    passes = 1

    @staticmethod
    def cells(n: int, dim: int) -> tuple[int, int]:
        """Cells held, and cells computed in a pass, for one vector."""
        return 4 * dim, n * dim

    def __init__(self, n: int, vectors: dict[str, tuple[np.ndarray, np.ndarray]], columns: pa.Table):
        self.n, self.vectors, self.columns = n, vectors, columns

    def tile(self, turn: int, at: int, w: np.ndarray) -> None:
        raise NotImplementedError

    def between(self, turn: int) -> None:
        pass

    def result(self) -> list[pa.Array]:
        raise NotImplementedError


def pieces(rows: int, width: int) -> Iterator[slice]:
    """Row ranges whose products with ``width`` matrix rows stay small."""
    step = max(1, CELLS // max(width, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def lists(values: np.ndarray, ok: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as an Arrow list array; null where not ``ok``."""
    rows, width = values.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    mask = None if ok is None or ok.all() else pa.array(~ok)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()), mask=mask)


def row_blocks(W: DataFrame, row: str = "row", vec: str = "w", tile_rows: int | None = None) -> tuple[DataFrame, int, int]:
    """Blocks (at, offsets, cells, _step) of a matrix table whose rows are stored once, its number of rows and its width.

    Rows that the table lacks are zero; of repeated rows one counts.
    """
    rows = stored(W.where(F.col(row) >= 0).select(F.col(row).cast("bigint").alias("row"), F.col(vec).cast("array<double>").alias("w")), "matrix-rows")
    shape = rows.agg(F.max("row").alias("last"), F.max(F.size("w")).alias("dim")).first()
    if shape["last"] is None:
        raise ValueError("the matrix has no rows")
    n, dim = shape["last"] + 1, shape["dim"]
    step = tile_rows or max(1, TILE_BYTES // (8 * dim))
    at = F.floor(F.col("row") / step) * step
    held = rows.groupBy("row").agg(F.max("w").alias("w")).groupBy(at.alias("at")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("row") - at).cast("int").alias("offset"), "w"))).alias("rows")
    )
    every = W.sparkSession.range(0, n, step).withColumnRenamed("id", "at").join(held, "at", "left")
    empty = F.array()
    blocks = every.select(
        "at", F.coalesce("rows.offset", empty.cast("array<int>")).alias("offsets"),
        F.coalesce(F.flatten("rows.w"), empty.cast("array<double>")).alias("cells"), F.lit(step).alias("_step"),
    )
    return blocks, n, dim


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Doubles of a list column; a null, short or long vector, or one with a null, is absent and reads as zero."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = sizes == dim
    if ok.all() and not column.flatten().null_count:
        return column.flatten().to_numpy().reshape(-1, dim), ok
    out = np.zeros((len(column), dim))
    if ok.any():
        cells = column.filter(pa.array(ok)).flatten()
        holes = cells.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
        out[ok] = cells.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
        ok[np.flatnonzero(ok)[holes]] = False
        out[~ok] = 0.0
    return out, ok


def _runs(batches) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(group, turn, rows) in the order of the sort."""
    for batch in batches:
        group, turn = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(turn) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if hi > lo:
                yield int(group[lo]), int(turn[lo]), batch.slice(lo, hi - lo)


def tiled(df: DataFrame, W: DataFrame, key: list[str], vecs: list[str], make, out: list[StructField], tile_rows: int | None = None) -> DataFrame:
    """``df`` with the columns ``out`` that a fold makes for its rows; ``make(n, vectors, columns)`` builds the fold.

    ``key`` names the columns that tell rows apart; they only decide which rows share a task.
    """
    blocks, n, dim = row_blocks(W, tile_rows=tile_rows)
    held, computed = make.cells(n, dim)
    held += COPIES * dim * len(vecs)
    size = max(1, min(GROUP_BYTES // (8 * held), GROUP_CELLS // max(computed, 1)))
    groups = max(1, -(-df.count() // size))
    passes, fields = make.passes, df.schema.fields
    schema = StructType([*[f for f in fields if f.name not in {o.name for o in out}], *out])
    kept = [f.name for f in schema.fields[: len(schema) - len(out)]]

    group = F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int")
    nothing = F.lit(None)
    vectors = df.select(
        group.alias("_group"), F.lit(0).alias("_turn"), F.lit(0).cast("bigint").alias("at"), F.struct(*df.columns).alias("_row"),
        nothing.cast("array<int>").alias("offsets"), nothing.cast("array<double>").alias("cells"), nothing.cast("int").alias("_step"),
    )
    turns = F.explode(F.sequence(F.lit(1), F.lit(passes)))
    copies = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        "_group", turns.alias("_turn"), "at", nothing.cast(vectors.schema["_row"].dataType).alias("_row"), "offsets", "cells", "_step"
    )
    laid = vectors.unionByName(copies).repartitionById(groups, F.col("_group")).sortWithinPartitions("_group", "_turn", "at")

    def block(piece: pa.RecordBatch, k: int) -> tuple[int, np.ndarray]:
        at = piece.column(2)[k].as_py()
        w = np.zeros((min(piece.column(6)[k].as_py(), n - at), dim))
        offsets = piece.column(4)[k].values.to_numpy()
        if len(offsets):
            w[offsets] = piece.column(5)[k].values.to_numpy().reshape(-1, dim)
        return at, w

    def work(batches):
        for _, run in groupby(_runs(batches), key=lambda r: r[0]):
            waiting, fold, done = [], None, 0
            rows = table = None
            for _, turn, piece in run:
                if turn == 0:
                    waiting.append(pa.RecordBatch.from_struct_array(piece.column(3)))
                elif waiting:
                    if fold is None:
                        rows = pa.Table.from_batches(waiting).combine_chunks()
                        waiting = [None]
                        fold = make(n, {v: _matrix(rows[v].combine_chunks(), dim) for v in vecs}, rows)
                    if done and turn > done:
                        fold.between(done)
                    done = turn
                    for k in range(piece.num_rows):
                        fold.tile(turn, *block(piece, k))
            if fold is not None:
                fold.between(done)
                table = pa.table([*[rows[c] for c in kept], *fold.result()], names=schema.names)
                fold = None
                yield from table.to_batches(max_chunksize=max(1, TILE_BYTES // (8 * max(dim, 1))))

    return laid.mapInArrow(work, schema)
