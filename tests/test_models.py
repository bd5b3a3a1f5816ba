import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal import fixtures as fx
from veracal.operators import metrics as m, probe as p, trajectory as tr
from veracal.operators.confidence import mlp_score
from veracal.plans.evaluation import evaluate_probe
from veracal.streaming.incremental import current_metrics, score_stream


def views(spark, n=60, dim=5):
    rng = np.random.default_rng(1)
    h = rng.normal(size=(n, dim))
    y = (h[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, h[i].tolist(), (h[i] * 0.1).tolist(), int(y[i]), int(i % 7 != 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, h_base array<double>, h_blank array<double>, y int, mask int")
    return df.repartition(4), h, y


def test_gradient_matches_finite_differences(spark):
    df, _, _ = views(spark)
    rng = np.random.default_rng(2)
    theta = rng.normal(size=6) * 0.3
    pos = df.where("y = 1").count()
    active = df.agg(F.sum(F.col("y") * F.col("mask"))).first()[0] + 1e-8
    args = (60, (60 - pos) / pos, active, True, True, 0.7, 0.5, 0.4)
    grad, loss = p._gradient(df, theta, *args)
    want = p.probe_loss(df, theta[:-1].tolist(), float(theta[-1]), "full", 0.7, 0.5, 0.4).first()["loss"]
    assert loss == pytest.approx(want, abs=1e-9)
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-6
        up = p._gradient(df, theta + step, *args)[1]
        down = p._gradient(df, theta - step, *args)[1]
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_fit_lowers_the_loss_and_ranks(spark):
    df, _, _ = views(spark)
    w, b, history = p.fit_linear(df, "full", steps=15)
    assert history[-1] < history[0]
    scored = mlp_score(df, "h_base", [(w[None, :], np.array([b]))], "c")
    assert m.auroc(scored, []).first()["auroc"] > 0.9


def test_trajectory_features_by_definition(spark):
    rng = np.random.default_rng(4)
    W = rng.normal(size=(6, 4))
    h = rng.normal(size=(9, 4))
    t = rng.integers(0, 6, 9)
    wdf = spark.createDataFrame([(i, W[i].tolist()) for i in range(6)], "row int, w array<double>")
    df = spark.createDataFrame([(i, h[i].tolist(), int(t[i])) for i in range(9)], "k int, h array<double>, token_id int").repartition(3)
    whole = {r["k"]: r for r in tr.trajectory_features(df, wdf, ["k"], radius=2.0, steps=4).collect()}
    sliced = {r["k"]: r for r in tr.trajectory_features(df, wdf, ["k"], radius=2.0, steps=4, tile_rows=4).collect()}

    def soft(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    for i in range(9):
        z0 = W @ h[i]
        p0 = soft(z0)
        g = W.T @ p0 - W[t[i]]
        ks = [W @ (h[i] + k * 0.5 * g / np.linalg.norm(g)) for k in range(1, 5)]
        flip = next((k * 0.5 for k, z in enumerate(ks, 1) if z.argmax() != z0.argmax()), float("inf"))
        f = [0.0] + [max(0.0, np.log(p0[t[i]]) - np.log(soft(z)[t[i]])) for z in ks]
        m_ = [(p0 + soft(z)) / 2 for z in ks]
        js = [0.5 * (x * np.log(x / p0)).sum() + 0.5 * (x * np.log(x / soft(z))).sum() for x, z in zip(m_, ks)]
        for got in (whole[i], sliced[i]):
            assert got["epsilon_to_flip_token"] == flip
            assert got["pei_value_token"] == pytest.approx(sum((a + b) / 2 for a, b in zip(f, f[1:])) / 4)
            assert got["jacobian_norm_token"] == pytest.approx(np.linalg.norm(g))
            assert got["js_div_perturbed_from_original_mean"] == pytest.approx(np.mean(js))
            assert got["js_div_perturbed_from_original_std"] == pytest.approx(np.std(js))
            assert got["original_std_logits"] == pytest.approx(z0.std(ddof=1))
        for name in tr.FEATURES:
            assert whole[i][name] == pytest.approx(sliced[i][name], abs=1e-9), name


def test_parameter_count(spark):
    df = spark.createDataFrame([("0",), ("256",), ("512,256",)], "s string")
    got = [r[0] for r in df.select(p.param_count(F.col("s"), 10)).collect()]
    assert got == [11, 10 * 256 + 256 + 257, 10 * 512 + 512 + 512 * 256 + 256 + 257]


def test_early_stop_replay(spark):
    scores = [0.1, 0.5, 0.4, 0.5, 0.3, 0.9]
    rows = [("a", i, s) for i, s in enumerate(scores)] + [("b", i, s) for i, s in enumerate([0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "trial string, epoch long, score double")
    got = {r["trial"]: (r["best_epoch"], r["best_score"], r["last_epoch"], r["stopped_early"]) for r in p.replay_early_stop(df, patience=3).collect()}
    assert got == {"a": (1, 0.5, 4, True), "b": (2, 0.3, 2, False)}


def test_stream_equals_batch(spark, sf, tmp_path):
    P = fx.predictions(spark, sf)
    parts = P.withColumn("part", (F.col("sample_id") % 3).cast("int"))
    by, key, src = ["method", "dataset"], ["sample_id", "method", "vlm", "seed"], str(tmp_path / "in")

    def run():
        score_stream(spark, src, P.schema, str(tmp_path / "out"), str(tmp_path / "ck"), key, by, files_per_batch=1).awaitTermination()
        return {tuple(r[x] for x in by): (r["n_samples"], round(r["auroc"], 9), round(r["ece"], 9)) for r in current_metrics(spark, str(tmp_path / "out"), by).collect()}

    parts.where("part < 2").drop("part").coalesce(2).write.parquet(src)
    run()
    parts.where("part >= 1").drop("part").coalesce(1).write.mode("append").parquet(src)
    got = run()
    assert run() == got
    want = {tuple(r[x] for x in by): (r["n_samples"], round(r["auroc"], 9), round(r["ece"], 9)) for r in m.all_metrics(P, by).collect()}
    assert got == want


def test_evaluation_plan(spark, tmp_path):
    df, h, y = views(spark)
    samples = df.select(F.col("sample_id").cast("string").alias("hash_id"), "h_base", F.when(F.col("sample_id") != 5, F.col("y")).alias("is_correct"))
    dims = samples.where("hash_id < '4'").select("hash_id", F.lit("d1").alias("dataset"))
    done = samples.where("hash_id = '7'")
    out = evaluate_probe(samples, done, dims, [(np.eye(5)[:1] * 3, np.zeros(1))], str(tmp_path), "org/name").collect()
    overall = next(r for r in out if r["level"] == 0)
    assert overall["n_samples"] == 58
    assert {r["dataset"] for r in out if r["level"] == 2} == {"d1", "unknown"}
    assert spark.read.json(str(tmp_path / "summary")).first()["overall"]["n_samples"] == 58


def test_early_stop_counts_evaluations_and_skips_nan(spark):
    nan = float("nan")
    rows = [("a", 0, 0.5, 1.0), ("a", 5, nan, 2.0), ("a", 10, 0.9, 3.0), ("b", 0, None, 1.0), ("b", 1, 0.2, 2.0), ("b", 2, nan, 3.0), ("b", 3, 0.1, 4.0), ("b", 4, 0.8, 5.0), ("c", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "trial string, epoch long, score double, tau double")
    got = {r["trial"]: tuple(r)[1:] for r in p.replay_early_stop(df, patience=2, point=["tau"]).collect()}
    assert got == {"a": (10, 0.9, 10, False, 3.0), "b": (1, 0.2, 3, True, 2.0), "c": (None, None, 0, False, None)}


def test_stream_state_is_its_own(spark, tmp_path):
    """Null keys count once, the first of a batch is by order, and earlier results are not read again."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "a string, b int, y int, c double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        score_stream(spark, src, spark.createDataFrame([], schema).schema, out, ck, ["a", "b"], ["y"]).awaitTermination()

    arrive([("x", 1, 1, 0.9), ("x", 1, 1, 0.4), (None, 1, 0, 0.3), ("x", None, 1, 0.7), (None, None, 1, 0.2), (None, 1, 0, 0.3), ("z", 1, None, 0.5)])
    first = {(r["a"], r["b"]): r["c"] for r in spark.read.parquet(f"{out}/scored").collect()}
    assert first == {("x", 1): 0.4, (None, 1): 0.3, ("x", None): 0.7, (None, None): 0.2}
    # what the first batch left is unreadable now; the state is not
    for path in (tmp_path / "out").rglob("*.parquet"):
        path.write_bytes(b"no parquet")
        for crc in path.parent.glob(".*.crc"):
            crc.unlink()
    arrive([("x", 1, 1, 0.1), (None, 1, 0, 0.1), (None, None, 0, 0.1), ("z", 1, 0, 0.6), ("w", 2, 1, 0.8), ("w", 2, 0, 0.8)])
    batches = sorted(p.name for p in (tmp_path / "out" / "scored").iterdir())
    later = [tuple(r) for r in spark.read.parquet(f"{out}/scored/{batches[-1]}").collect()]
    assert len(batches) == 2 and sorted(later) == [("w", 2, 0, 0.8), ("z", 1, 0, 0.6)]
    with pytest.raises(Exception):
        current_metrics(spark, out, ["y"]).collect()


def test_stream_state_is_on_disk_whatever_the_session_says(spark, tmp_path):
    name, memory = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    P = spark.createDataFrame([(k % 40, "m", float(k % 10) / 10, k % 2) for k in range(60)], "a int, b string, c double, y int")
    P.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(name)
    spark.conf.set(name, memory)
    try:
        stream = score_stream(spark, str(tmp_path / "in"), P.schema, str(tmp_path / "out"), str(tmp_path / "ck"), ["a", "b"], ["b"])
        stream.awaitTermination()
        assert spark.conf.get(name) == memory
    finally:
        spark.conf.set(name, before)
    assert any(key.startswith("rocksdb") for key in stream.recentProgress[0].stateOperators[0].customMetrics)
    assert current_metrics(spark, str(tmp_path / "out"), ["b"]).first()["n_samples"] == 40


def test_days_of_the_stream_are_written_by_all_cores(spark, sf, monkeypatch):
    from veracal.catalog import sources

    seen = {}

    def watched(spark, source, schema, *args, **kwargs):
        days = spark.read.parquet(source).selectExpr("sample_id % 3 as day", "input_file_name() as file").groupBy("day").agg(F.countDistinct("file").alias("n"))
        seen.update({r.day: r.n for r in days.collect()}, batch=kwargs["files_per_batch"])
        return score_stream(spark, source, schema, *args, **kwargs)

    monkeypatch.setattr(sources, "score_stream", watched)
    assert sources.st01(spark, sf).count() == 25
    cores = spark.sparkContext.defaultParallelism
    assert seen[1] == seen[2] == cores and seen[0] == 2 * cores and seen["batch"] == 2 * cores
