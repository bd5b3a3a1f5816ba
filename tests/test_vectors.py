"""Bounded selection, smoothing, pooled attention and lookups against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal.functions import vectors as v
from veracal.operators import confidence as c


def test_top_k_and_margin_in_one_walk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-4, 4, int(rng.integers(2, 30)))]) for i in range(60)]
    rows += [(100, [float("-inf"), 1.0, float("inf")]), (101, [2.0, 2.0]), (102, [0.0, -0.0, -1.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    got = {r["i"]: r for r in df.select("i", v.top_k(F.col("x"), 3).alias("top"), v.margin(F.col("x")).alias("m")).collect()}
    for i, x in rows:
        want = sorted(((-a, k) for k, a in enumerate(x)))[:3]
        assert [(-s["value"], s["index"]) for s in got[i]["top"]] == want, x
        first, second = sorted(x, reverse=True)[:2]
        assert got[i]["m"] == first - second
    odd = spark.createDataFrame([([1.0, None, 5.0, None, 2.0],), ([3.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in odd.select(v.margin(F.col("x"))).collect()] == [3.0, None, None, None]
    assert [len(r[0] or []) for r in odd.select(v.top_k(F.col("x"), 2)).collect()] == [2, 1, 0, 0]


def test_smoothing(spark):
    x = [float(k * k % 7) for k in range(12)]
    got = spark.createDataFrame([(1, x)], "k int, x array<double>").select(v.null_view(F.col("x"), F.col("k"), "smoothed", radius=3)).first()[0]
    assert got == pytest.approx([np.mean(x[max(0, i - 3):i + 4]) for i in range(12)])


def test_attention_of_ragged_heads(spark):
    rng = np.random.default_rng(2)
    heads = [(s, layer, head, [float(w) for w in rng.random(3 + (layer + head + s) % 3)]) for s in range(4) for layer in range(3) for head in range(2)]
    heads += [(9, 0, 0, [0.0, 0.0]), (10, 0, 0, [1.0, None, 3.0]), (11, 0, 0, None), (None, 0, 0, [1.0, 1.0])]
    df = spark.createDataFrame(heads, "sample int, layer int, head int, weights array<double>").repartition(5)
    for how in ("mean", "max", "last_layer"):
        out = c.aggregate_attention(df, ["sample"], how)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r["sample"]: r["attention"] for r in out.collect()}
        for s in range(4):
            mine = [h for h in heads if h[0] == s and (how != "last_layer" or h[1] == 2)]
            out = []
            for pos in range(max(len(h[3]) for h in mine)):
                layers = {}
                for h in mine:
                    if pos < len(h[3]):
                        layers.setdefault(h[1], []).append(h[3][pos])
                fold = max if how == "max" else np.mean
                out.append(fold([fold(x) for x in layers.values()]))
            assert got[s] == pytest.approx(list(np.array(out) / sum(out)))
        assert got[9] == [0.0, 0.0] and got[10] == [0.25, None, 0.75] and got[11] == [] and got[None] == [0.5, 0.5]
    with pytest.raises(ValueError):
        c.aggregate_attention(df, ["sample"], "median")


def test_repeated_lookup_keys_do_not_multiply_rows(spark):
    replies = spark.createDataFrame([(1, "no number"), (2, "Confidence: 80%"), (3, None)], "sample_id int, reply string")
    judged = spark.createDataFrame([(1, "0.3"), (1, "0.4"), (3, None), (3, "0.5"), (None, "0.9")], "sample_id int, judge_text string")
    assert c.two_stage_confidence(replies, judged).count() == 3
    base = spark.createDataFrame([(1, [1.0, 0.0], 0.9, 0)] * 2, "sample_id int, h array<double>, p_top1 double, top1 int")
    view = spark.createDataFrame([(1, "blank", [0.0, 1.0], 0.4, 1, 1)], "sample_id int, view string, h array<double>, p_of_base double, top1 int, mask int")
    assert [(r["view"], r["flip"]) for r in c.view_diagnostics(base, view).collect()] == [("blank", 1)]
