import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal.functions.text import percent, stars
from veracal.operators import report as r
from veracal.operators.joins import override
from veracal.plans.report_tables import null_comparison


def long(spark, values):
    rows = [(n, s, "auroc", float(v)) for n, vs in values.items() for s, v in enumerate(vs)]
    return spark.createDataFrame(rows, "null_type string, seed int, metric string, value double")


def test_signed_rank_golden(spark):
    base = [0.1, 0.2, 0.3, 0.4, 0.5]
    df = long(spark, {
        "black": base,
        "w0": [b + d for b, d in zip(base, (0.01, 0.02, 0.03, 0.04, 0.05))],
        "w1": [b + d for b, d in zip(base, (-0.01, 0.02, 0.03, 0.04, 0.05))],
        "w2": [b + d for b, d in zip(base, (0.01, -0.02, 0.03, 0.04, 0.05))],
        "few": base[:4],
    })
    got = {x["null_type"]: x["p"] for x in r.signed_rank(df, ["metric"], "null_type", "black").collect()}
    assert (got["w0"], got["w1"], got["w2"], got["few"]) == (0.0625, 0.125, 0.1875, None)


def by_signs(ranks, w):
    """The p-value by all sign patterns."""
    sums = [sum(x for i, x in enumerate(ranks) if s >> i & 1) for s in range(1 << len(ranks))]
    return min(1.0, 2 * sum(x <= w for x in sums) / len(sums))


def test_signed_rank_p_counts_sign_patterns():
    for ranks in ([1, 2, 3, 4, 5, 6], [1.5, 1.5, 3, 4.5, 4.5], [2, 2, 2, 4], [3.5] * 6, [1]):
        pairs = sorted({(int(2 * x), ranks.count(x)) for x in ranks})
        for w2 in range(int(2 * sum(ranks)) + 1):
            assert r.signed_rank_p(pairs, w2 / 2) == pytest.approx(by_signs(ranks, w2 / 2))
    # fifty ranks: the distribution is symmetric and close to its normal limit
    fifty, mean, std = [(2 * k, 1) for k in range(1, 51)], 50 * 51 / 4, math.sqrt(50 * 51 * 101 / 24)
    assert r.signed_rank_p(fifty, mean) == 1.0
    assert r.signed_rank_p(fifty, mean - 2 * std) == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=2e-3)


def test_signed_rank_ties_and_zeros(spark):
    df = long(spark, {"black": [0.0] * 8, "x": [0.0, -1.0, 1.0, 1.0, 2.0, 2.0, 3.0, -4.0]})
    row = r.signed_rank(df, ["metric"], "null_type", "black").first()
    d = np.array([1, -1, -1, -2, -2, -3, 4.0])
    ranks = np.array([2, 2, 2, 4.5, 4.5, 6, 7])
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    assert (row["n_pairs"], row["n"], row["w"]) == (8, 7, w)
    assert row["p"] == pytest.approx(by_signs(list(ranks), w))
    # above the exact range: normal, with tie correction
    var = 7 * 8 * 15 / 24 - ((27 - 3) + (8 - 2)) / 48
    far = r.signed_rank(df, ["metric"], "null_type", "black", exact_max=6).first()
    assert far["p"] == pytest.approx(math.erfc(abs((w - 14) / math.sqrt(var)) / math.sqrt(2)))
    same = r.signed_rank(long(spark, {"black": [1.0] * 6, "x": [1.0] * 6}), ["metric"], "null_type", "black").first()
    assert (same["n_pairs"], same["n"], same["p"]) == (6, 0, None)


def test_mean_of_means_is_not_pooled(spark):
    rows = [("a", "v1", 1, "ece", 0.0), ("a", "v1", 2, "ece", 0.2), ("a", "v2", None, "ece", 0.5)]
    df = spark.createDataFrame(rows, "method string, vlm string, seed int, metric string, value double")
    assert r.mean_of_means(df, ["method"]).first()["ece"] == pytest.approx(0.3)
    assert r.std_of_means(df, ["method"]).first()["ece"] == pytest.approx(0.2)
    assert r.mean_std(df.where("vlm = 'v1'"), ["method"]).first()["std"] == pytest.approx(np.std([0, 0.2], ddof=1))


def test_delta_turns_lower_is_better(spark):
    rows = [("black", 1, "ece", 0.1), ("new", 1, "ece", 0.3), ("black", 1, "auroc", 0.6), ("new", 1, "auroc", 0.8)]
    df = spark.createDataFrame(rows, "null_type string, seed int, metric string, value double")
    got = {x["metric"]: x["delta"] for x in r.delta(df, [], "null_type", "black").collect()}
    assert got == {"ece": pytest.approx(-0.2), "auroc": pytest.approx(0.2)}
    assert null_comparison(df).count() == 4


def test_formats(spark):
    df = spark.createDataFrame([(0.12345, 0.0005), (None, 0.02), (float("nan"), 0.2)], "v double, p double")
    rows = df.select(percent(F.col("v")).alias("v"), stars(F.col("p")).alias("p")).collect()
    assert [x["v"] for x in rows] == ["12.35", "—", "—"] or [x["v"] for x in rows] == ["12.34", "—", "—"]
    assert [x["p"] for x in rows] == ["<0.001***", "0.020*", "0.200"]


def test_override_wins_even_when_null(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", None)], "k string, v int")
    got = {x["k"]: (x["v"], x["origin"]) for x in override(a, b, "k", "v").collect()}
    assert got == {"x": (None, "merged"), "y": (1, "kept"), "z": (None, "missing")}
