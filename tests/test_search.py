"""Grid fits against finite differences, against the single fit, and the choice of a configuration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal.operators import probe as p, search as s
from veracal.operators.metrics import all_metrics


def rows(spark, n=80, dim=4, seed=1):
    rng = np.random.default_rng(seed)
    h = rng.normal(size=(n, dim))
    y = (h[:, 0] * h[:, 1] + 0.2 * rng.normal(size=n) > 0).astype(int)
    data = [(i, h[i].tolist(), (h[i] * 0.2).tolist(), int(y[i]), int(i % 5 != 0)) for i in range(n)]
    return spark.createDataFrame(data, "sample_id long, h_base array<double>, h_blank array<double>, y int, mask int").repartition(3), h, y


@pytest.mark.parametrize("hidden", [(), (5,), (6, 3)])
@pytest.mark.parametrize("variant", list(p.VARIANTS))
def test_gradients_match_finite_differences(hidden, variant):
    rng = np.random.default_rng(2)
    config = s.Config("c", hidden, variant, beta=0.7, lam=0.4, margin=0.5)
    layers = [(rng.normal(size=w.shape), rng.normal(size=b.shape)) for w, b in config.start(3)]
    x, blank, y, mask = rng.normal(size=(20, 3)), rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), rng.integers(0, 2, 20).astype(float)
    totals = s.Totals(20, 1.3, 7.0)

    def loss(flat, into=None):
        now = s._shaped(flat, layers)
        return s.loss_and_gradient(config, now, x, blank, y, mask, totals, into or [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers])

    flat, grad = s._flat(layers), [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    loss(flat, grad)
    for k, g in enumerate(s._flat(grad)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        assert g == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-5)


def test_one_pass_equals_separate_fits(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 3)
    df, _, _ = rows(spark)
    configs = [s.Config("a", beta=0.2), s.Config("b", variant="no_rank", lr=0.1), s.Config("c", (4,), seed=3)]
    together = s.fit_grid(df, configs, 4)
    w, b, history = p.fit_linear(df, "no_rank", steps=4, lr=0.1)
    assert np.allclose(together["b"].layers[0][0][0], w) and together["b"].layers[0][1][0] == pytest.approx(b)
    assert together["b"].losses == pytest.approx(history)
    alone = s.fit_grid(df, configs[2:], 4)["c"]
    assert all(np.allclose(x, y) for one, two in zip(alone.layers, together["c"].layers) for x, y in zip(one, two))
    again = s.fit_grid(df, configs, 4)
    assert all(np.array_equal(x, y) for c in "abc" for one, two in zip(again[c].layers, together[c].layers) for x, y in zip(one, two))


def test_search_fits_scores_and_chooses(spark):
    df, h, y = rows(spark, 200)
    held = F.col("sample_id") % 4 == 0
    # only hidden layers can tell these classes apart; the widest probe is over the budget
    configs = [s.Config("linear"), s.Config("hidden", (16,), lr=1.0, lam=0.0, beta=0.0, seed=5), s.Config("wide", (4000,))]
    found, fitted = s.search(df.where(~held), df.where(held), configs, "sample_id", steps=60, most=1000)
    got = {r["config"]: r for r in found.collect()}
    assert set(got) == {"linear", "hidden"} == set(fitted)
    assert [c for c, r in got.items() if r["chosen"]] == ["hidden"] and got["hidden"]["score"] > got["linear"]["score"]
    assert (got["linear"]["n_params"], got["hidden"]["n_params"]) == (5, 4 * 16 + 16 + 17)
    scored = s.score_grid(df.where(held), fitted, "sample_id").where("config = 'hidden'")
    assert all_metrics(scored, []).first()["auroc"] == pytest.approx(got["hidden"]["score"])
    assert fitted["hidden"].losses[-1] < fitted["hidden"].losses[0]


def test_equal_scores_and_missing_values(spark):
    df, _, _ = rows(spark, 40)
    holes = df.unionByName(spark.createDataFrame([(900, None, None, 1, 1), (901, [1.0] * 4, [1.0] * 4, None, 1)], df.schema))
    found, fitted = s.search(holes, holes.where("y is not null"), [s.Config("b"), s.Config("a")], "sample_id", steps=2)
    assert {r["config"]: r["chosen"] for r in found.collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError):
        s.fit_grid(df.where("false"), [s.Config("a")])
