"""Matrix products that stream row blocks, against whole matrices in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal.operators import tiles, trajectory as tr


def inputs(spark, rows=23, n=11, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    W, h, t = rng.normal(size=(n, dim)), rng.normal(size=(rows, dim)), rng.integers(0, n, rows)
    W[[2, 7]] = 0
    matrix = spark.createDataFrame([(i, W[i].tolist()) for i in range(n) if i not in (2, 7)], "row long, w array<double>").repartition(3)
    df = spark.createDataFrame([(i, h[i].tolist(), int(t[i]), f"x{i}") for i in range(rows)], "k int, h array<double>, token_id int, extra string")
    return df.repartition(5), matrix, h, W, t


def gradients(h, W, t):
    z = h @ W.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True) @ W - W[t]


@pytest.mark.parametrize("tile_rows", [1, 3, None])
def test_products_and_gradients(spark, tile_rows, monkeypatch):
    # several groups of vectors, each with a copy of the matrix behind it
    monkeypatch.setattr(tiles, "GROUP_BYTES", 8 * 16 * 5)
    df, matrix, h, W, t = inputs(spark)
    logits = {r["k"]: r for r in tr.project(df, matrix, ["k"], tile_rows=tile_rows).collect()}
    slopes = {r["k"]: r for r in tr.gradient(df, matrix, ["k"], tile_rows=tile_rows).collect()}
    assert sorted(logits) == sorted(slopes) == list(range(23)) and all(r["extra"] == f"x{k}" for k, r in slopes.items())
    assert np.allclose([logits[k]["logits"] for k in range(23)], h @ W.T)
    assert np.allclose([slopes[k]["g"] for k in range(23)], gradients(h, W, t))


def test_large_logits_do_not_overflow(spark):
    df, matrix, h, W, t = inputs(spark)
    far = df.withColumn("h", F.transform("h", lambda x: x * 1000))
    got = {r["k"]: r["g"] for r in tr.gradient(far, matrix, ["k"], tile_rows=2).collect()}
    assert np.allclose([got[k] for k in range(23)], gradients(h * 1000, W, t))


def test_absent_vectors_and_tokens(spark):
    df, matrix, h, W, t = inputs(spark)
    broken = df.withColumn("h", F.when(F.col("k") == 1, None).when(F.col("k") == 2, F.slice("h", 1, 2)).when(F.col("k") == 3, F.array(F.lit(1.0), F.lit(None), F.lit(1.0), F.lit(1.0))).otherwise(F.col("h")))
    broken = broken.withColumn("token_id", F.when(F.col("k") == 4, 99).when(F.col("k") == 5, None).when(F.col("k") == 6, -1).otherwise(F.col("token_id")))
    logits = {r["k"]: r["logits"] for r in tr.project(broken, matrix, ["k"], tile_rows=4).collect()}
    assert [k for k in range(23) if logits[k] is None] == [1, 2, 3]
    slopes = {r["k"]: r["g"] for r in tr.gradient(broken, matrix, ["k"]).collect()}
    assert [k for k in range(23) if slopes[k] is None] == [1, 2, 3, 4, 5, 6]
    features = {r["k"]: r for r in tr.trajectory_features(broken, matrix, ["k"]).collect()}
    assert [k for k in range(23) if features[k]["pei_value_token"] is None] == [1, 2, 3, 4, 5, 6]
    steps = tr.step_measures(broken, matrix, ["k"], steps=3).collect()
    assert len(steps) == 69 and sum(r["perturbed_entropy"] is None for r in steps) == 18
    want = gradients(h, W, t)
    assert all(np.allclose(slopes[k], want[k]) for k in range(7, 23))


def test_empty_tables(spark):
    df, matrix, *_ = inputs(spark)
    assert tr.trajectory_features(df.where("false"), matrix, ["k"]).collect() == []
    with pytest.raises(ValueError):
        tr.project(df, matrix.where("false"), ["k"])


def test_steps_and_features_agree(spark):
    df, matrix, *_ = inputs(spark)
    by_step = tr.trajectory_statistics(tr.step_measures(df, matrix, ["k"], 3.0, 4, tile_rows=2), ["k"])
    steps = {r["k"]: r for r in by_step.collect()}
    whole = {r["k"]: r for r in tr.trajectory_features(df, matrix, ["k"], 3.0, 4).collect()}
    for k, r in whole.items():
        for name in by_step.columns:
            assert r[name] == pytest.approx(steps[k][name], abs=1e-9), name


def test_groups_count_all_that_a_task_holds(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType, StructField

    from veracal.operators import tiles

    class Sized(tiles.Fold):
        @staticmethod
        def cells(n, dim):
            return dim, n * dim

        def tile(self, turn, at, w):
            pass

        def result(self):
            (h, _), = self.vectors.values()
            return [pa.array(np.full(len(h), len(h)))]

    monkeypatch.setattr(tiles, "GROUP_BYTES", 1 << 16)
    df = spark.range(4000).select("id", F.array(*[F.rand(k) for k in range(8)]).alias("h"))
    W = spark.range(3).select(F.col("id").alias("row"), F.array(*[F.lit(1.0)] * 8).alias("w"))
    got = tiles.tiled(df, W, ["id"], ["h"], Sized, [StructField("size", LongType())]).collect()
    # a vector is there four times: in the fold, as Arrow rows twice, as rows that leave
    assert len(got) == 4000 and 200 < max(r["size"] for r in got) < 384


def test_whole_vectors_are_not_copied():
    import pyarrow as pa

    from veracal.operators.tiles import _matrix

    values, ok = _matrix(pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]]).slice(1), 2)
    assert values.tolist() == [[1.0, 2.0], [3.0, 4.0]] and ok.all() and not values.flags.owndata and not values.flags.writeable
    values, ok = _matrix(pa.array([[1.0, None], [3.0, 4.0], None]), 2)
    assert values.tolist() == [[0.0, 0.0], [3.0, 4.0], [0.0, 0.0]] and ok.tolist() == [False, True, False]
