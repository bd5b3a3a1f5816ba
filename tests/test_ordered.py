import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veracal.operators import ordered as o
from veracal.operators.curate import balanced_shards, class_quotas, stratified_exact
from veracal.operators.pairs import random_partner
from veracal.operators.quality import runs


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 200).astype(float), "c": np.array([7.5]), "d": -rng.random(64)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in data.items()])).repartition(3)
    got = {r["g"]: r for r in o.describe(df, "v", ["g"], {"p25": 0.25, "p50": 0.5, "p99": 0.99}).collect()}
    for k, v in data.items():
        for name, p in (("p25", 25), ("p50", 50), ("p99", 99)):
            assert got[k][name] == pytest.approx(np.percentile(v, p), abs=1e-9), (k, name)
        assert got[k]["std"] == pytest.approx(v.std(), abs=1e-9)
        assert got[k]["mean"] == pytest.approx(v.mean(), abs=1e-9)


def test_running_sum_over_one_hot_group(spark):
    # every score of the group lies within a few ulps of one value
    rows = [("hot", 0.9 + i * 2.0**-53, i) for i in range(500)] + [("other", 0.1, 1)]
    df = spark.createDataFrame(rows, "g string, c double, v long").repartition(6)
    out = o.running(df, ["g"], ["c"], {"s": ("sum", F.col("v"))}, totals=True)
    got = out.where("g = 'hot'").groupBy("c").agg(F.max("s").alias("s"), F.max("s_total").alias("t")).orderBy("c").collect()
    frame = pd.DataFrame(rows, columns=["g", "c", "v"])
    want = frame[frame.g == "hot"].groupby("c").v.sum().sort_index().cumsum()
    assert [r["s"] for r in got] == want.tolist()
    assert got[0]["t"] == sum(range(500))


def test_dense_index_over_far_apart_keys(spark):
    keys = [0, 1, 5, 1 << 17, (1 << 18) + 3, 1 << 35, (1 << 36) + 1, (1 << 40) + 7, 1 << 60]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    got = o.dense_index(df, "k").orderBy("k").collect()
    assert [r["idx"] for r in got] == list(range(len(keys)))
    assert {r["n_total"] for r in got} == {len(keys)}


def test_shards_follow_the_floor_rule(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    got = {r["k"]: r["shard"] for r in balanced_shards(df, 5, "k").collect()}
    for i in range(5):
        for k in range(23 * i // 5, 23 * (i + 1) // 5):
            assert got[k] == i


def test_strata_sum_to_size(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("s"))
    quotas = class_quotas(df, "s", 333).collect()
    picked = stratified_exact(df, "s", "k", 333).collect()
    whole = stratified_exact(df, "s", "k", 5000).count()
    assert sum(r["quota"] for r in quotas) == 333 == len(picked) == len({r["k"] for r in picked})
    assert all(abs(r["quota"] - 333 * r["n"] / 1000) < 1 for r in quotas)
    assert whole == 1000


def test_partner_is_never_self(spark):
    df = spark.range(300).select((F.col("id") * 7).alias("k"))
    got = random_partner(df, "k", []).collect()
    lone = random_partner(df.limit(1), "k", []).collect()
    assert len(got) == 300 and all(r["k"] != r["other_k"] for r in got)
    assert len({r["other_k"] for r in got}) > 150
    assert lone[0]["k"] == lone[0]["other_k"]


def test_partners_among_more_rows_than_32_bits_tell_apart(spark):
    from veracal.functions.keys import other_position, row_draw

    n = 1 << 44
    draws = spark.range(4000).select(F.col("id"), row_draw(F.col("id").cast("string"), 42, "partner").alias("d"), (F.col("id") * (n // 4000)).alias("own"))
    picked = [r[0] for r in draws.select(other_position(F.col("d"), F.col("own"), F.lit(n))).collect()]
    # even over all positions, past those that 32 bits reach
    quarters = np.bincount([p * 4 // n for p in picked], minlength=4)
    assert min(picked) >= 0 and max(picked) < n and len(set(picked)) == 4000 and quarters.min() > 900
    small = spark.range(5).crossJoin(spark.range(200).withColumnRenamed("id", "d")).select("id", other_position(F.col("d"), F.col("id"), F.lit(5)).alias("p")).collect()
    assert all(r["p"] != r["id"] for r in small) and {(r["id"], r["p"]) for r in small} == {(a, b) for a in range(5) for b in range(5) if a != b}
    one = spark.range(1).select(other_position(F.lit(7), F.lit(0), F.lit(1)).alias("p")).first()["p"]
    assert one == 0


def test_runs_skip_nulls_but_keep_positions(spark):
    values = [None, "a", "a", None, "a", "b", None, None, "a", None]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string").repartition(3)
    got = sorted(tuple(r) for r in runs(df, "v", "i").collect())
    assert got == [("a", 1, 4, 4), ("a", 8, 9, 2), ("b", 5, 7, 3)]


def test_exploded_input_is_ordered_by_ranges(spark):
    # the planner takes the exploded rows for a few bytes; one group holds them all
    df = spark.range(10).select(F.lit("hot").alias("g"), F.explode(F.expr("sequence(id * 3000, id * 3000 + 2999)")).alias("k"))
    out = o.dense_index(df, "k", ["g"])
    assert out.where("idx <> k or n_total <> 30000").count() == 0


def _rows():
    rng = np.random.default_rng(8)
    values = [None, -np.inf, -1e300, -10_000_000.0, -1.5, -0.0, 1e-300, 0.25, 0.3, 7.0, 1e300, np.inf]
    out, at = [], 0
    for g in [None, "a", "b", "hot", "hot", "hot", "z"]:
        for _ in range(int(rng.integers(1, 60))):
            out.append((g, int(rng.integers(0, 3)) if g != "b" else None, at, values[int(rng.integers(0, len(values)))], None if rng.random() < 0.4 else f"s{at % 3}", int(rng.integers(-5, 9))))
            at += 1
    return [out[k] for k in rng.permutation(len(out))]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_a_plain_loop(spark, batch, descending):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, h int, k long, v double, s string, w long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        aggs = {"total": ("sum", F.col("w")), "last": ("last", F.col("s")), "top": ("peak", F.when(F.col("v") > -1e299, F.col("v"))), "half": ("sum", F.col("w") * 0.5)}
        out = o.running(df, ["g", "h"], ["k"], aggs, descending, inclusive=False, totals=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {r["k"]: r for r in out}
    assert len(out) == len(rows)
    for g, h in {(r[0], r[1]) for r in rows}:
        total, last, top, row = 0, None, None, None
        mine = sorted((r for r in rows if (r[0], r[1]) == (g, h)), key=lambda r: -r[2] if descending else r[2])
        for n, (_, _, k, v, s, w) in enumerate(mine, 1):
            total += w
            if v is not None and v > -1e299 and (top is None or v > top):
                top, row = v, n
            r = got[k]
            assert (r["total"], r["last"], r["top"], r["top_row"], r["half"]) == (total, last, top, row, total / 2), (g, h, n)
            assert r["total_total"] == sum(x[5] for x in mine) and (r["v"], r["s"]) == (v, s)
            last = s if s is not None else last


def test_nulls_of_the_order_come_first(spark):
    df = spark.createDataFrame([(-10_000_000,), (None,), (5,)], "k long")
    got = {r["k"]: r["n"] for r in o.running(df, [], ["k"], {"n": ("sum", F.lit(1))}).collect()}
    assert got == {None: 1, -10_000_000: 2, 5: 3}
    got = {r["k"]: r["n"] for r in o.running(df, [], ["k"], {"n": ("sum", F.lit(1))}, descending=True).collect()}
    assert got == {5: 1, -10_000_000: 2, None: 3}


def test_nothing_to_run_over(spark):
    df = spark.createDataFrame([], "g string, k long")
    assert o.running(df, ["g"], ["k"], {"n": ("sum", F.lit(1))}, totals=True).collect() == []


def test_quantiles_of_large_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (1e12, 3e12, 2e15, -4e11)], "v double")
    assert o.quantiles(df, "v", [], {"m": 0.5}).first()["m"] == 2e12
    assert o.quantiles(df.select(F.col("v").cast("long").alias("v")), "v", [], {"m": 0.5}).first()["m"] == 2e12
