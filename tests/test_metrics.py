import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from veracal.operators import metrics as m

from . import brute

EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.3, 0.6000000000000001, 0.7000000000000001, 0.9, 1.0, 1e-300, 1 - 2**-53]


def cases():
    rng = np.random.default_rng(5)
    out = {
        "uniform": (rng.integers(0, 2, 400), rng.random(400)),
        "ties": (rng.integers(0, 2, 300), np.round(rng.random(300), 1)),
        "edges": (rng.integers(0, 2, 200), rng.choice(EDGES, 200)),
        "saturated": (rng.integers(0, 2, 200), 1.0 - rng.integers(0, 60, 200) * 2.0**-53),
        "tiny": (rng.integers(0, 2, 200), rng.random(200) * 1e-18),
        "all_right": (np.ones(20, int), 0.5 + rng.random(20) / 2),
        "all_wrong": (np.zeros(20, int), 0.5 + rng.random(20) / 2),
        "constant": (rng.integers(0, 2, 50), np.full(50, 0.7)),
    }
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    frames = [pd.DataFrame({"g": k, "y": y.astype(int), "c": c.astype(float)}) for k, (y, c) in cases().items()]
    return spark.createDataFrame(pd.concat(frames)).repartition(5).cache()


def test_metrics_match_definitions(pairs):
    got = {r["g"]: r for r in m.all_metrics(pairs, ["g"]).collect()}
    for k, (y, c) in cases().items():
        r = got[k]
        assert r["n_samples"] == len(y)
        assert r["ece"] == pytest.approx(brute.ece(y, c), abs=1e-12), k
        assert r["brier"] == pytest.approx(((c - y) ** 2).mean(), abs=1e-12)
        assert r["auroc"] == pytest.approx(brute.auroc(y, c), abs=1e-12), k
        assert r["aucpr"] == pytest.approx(brute.aucpr(y, c), abs=1e-12), k
    assert got["all_right"]["precision"] == got["all_right"]["specificity"] == 1.0
    assert got["all_wrong"]["recall"] == 0.0
    assert got["constant"]["auroc"] == 0.5


def test_youden_matches_scan(pairs):
    got = {r["g"]: r["tau"] for r in m.youden(pairs, ["g"]).collect()}
    for k, (y, c) in cases().items():
        assert got[k] == pytest.approx(brute.youden(y, c), abs=1e-12), k


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.2), ("a", 1, 0.4), ("a", 0, 0.6)], "g string, y int, c double")
    got = {r["g"]: r["auroc"] for r in m.all_metrics(df, ["g"]).collect()}
    assert got == {None: 1.0, "a": 0.0}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g string, y int, c double")
    row = m.all_metrics(empty, []).first()
    assert (row["n_samples"], row["ece"], row["brier"], row["auroc"], row["aucpr"]) == (0, 1.0, 1.0, 0.5, 0.0)
    assert m.ece(empty, []).first()["ece"] == 1.0
    assert m.brier(empty, []).first()["brier"] == 1.0


def test_flip_keeps_ranking_and_brier(pairs):
    a = {r["g"]: r for r in m.all_metrics(pairs, ["g"]).collect()}
    b = {r["g"]: r for r in m.all_metrics(m.flip(pairs), ["g"]).collect()}
    for k in ("uniform", "ties"):
        assert a[k]["auroc"] == pytest.approx(b[k]["auroc"], abs=1e-12)
        assert a[k]["brier"] == pytest.approx(b[k]["brier"], abs=1e-12)
        assert a[k]["sensitivity"] != b[k]["sensitivity"]


def test_reliability_has_empty_bins(pairs):
    rows = m.reliability(pairs.where("g = 'constant'"), ["g"]).orderBy("bin").collect()
    assert [r["bin"] for r in rows] == list(range(10))
    assert [r["n"] for r in rows] == [0] * 7 + [50, 0, 0] or [r["n"] for r in rows] == [0] * 6 + [50, 0, 0, 0]
    assert np.isnan(rows[0]["accuracy"])


def test_levels_equal_separate_groupings(pairs):
    data = pairs.withColumn("h", (F.col("c") * 3).cast("int").cast("string"))
    levels = m.metrics_by_groups(data, ["g", "h"]).cache()
    one = {r["g"]: r["auroc"] for r in m.all_metrics(data, ["g"]).collect()}
    for r in levels.where("level = 1").collect():
        assert r["auroc"] == pytest.approx(one[r["g"]], abs=1e-12)
    assert levels.where("level = 0").count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from(EDGES + [0.25, 0.5, 0.75])), min_size=1, max_size=30))
def test_any_small_table(spark, rows):
    y, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = m.all_metrics(spark.createDataFrame([(int(a), float(b)) for a, b in rows], "y int, c double"), []).first()
    assert got["ece"] == pytest.approx(brute.ece(y, c), abs=1e-12)
    assert got["auroc"] == pytest.approx(brute.auroc(y, c), abs=1e-12)
    assert got["aucpr"] == pytest.approx(brute.aucpr(y, c), abs=1e-12)
