"""Quality statistics against plain Python, trees against their own rules and held-out labels."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veracal.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)]


TEXTS = [
    None, "", " \t\n", "one", "a b c a b c", "a a a a a", "x y z\nx y z\n\n\nx y z \nx y z", "né e  日本 # * $ % & | < >", "\x1c \x85 a\x00b",
    "w1 w2 w3 " * 40, " ".join(f"w{k}" for k in range(80)), "tail\n" * 3, "long line of words . " * 30_000, "\n".join(["same line here"] * 5 + ["other", "other "]),
]


def test_statistics_equal_plain_counting():
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(rng.choice(list("ab \n#."), 60)) for _ in range(300)]
    for text in texts:
        data = None if text is None else text.encode()
        assert quality.text_stats(data)[:5] == base(text), text[:80] if text else text


def test_repeated_windows_of_very_many_distinct_words(monkeypatch):
    words = [f"w{k}".encode() for k in range((1 << 21) + 5)] + [b"w7", b"w8", b"w9"]
    assert quality._repeated(words) == 6


def test_trees_keep_their_directions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 4))
    odds = -1.5 * x[:, 0] + np.sin(3 * x[:, 1]) + 2 * x[:, 2]
    y = (odds + rng.logistic(size=len(x)) > 0).astype(float)
    # a noisy bump against the direction that free trees follow
    y[(x[:, 0] > 0.4) & (x[:, 0] < 0.8)] = 1
    free, held = (quality.fit_trees(x[:3000], y[:3000], d) for d in ([0, 0, 0, 0], [-1, 0, 1, 0]))
    grid = np.linspace(-3, 3, 200)
    rises = {}
    for name, model in (("free", free), ("held", held)):
        for f in (0, 2):
            sign = -1 if f == 0 else 1
            steps = [np.diff(sign * model.score(np.where(np.arange(4) == f, grid[:, None], row))) for row in x[:40]]
            rises[name, f] = min(s.min() for s in steps)
    assert rises["held", 0] >= 0 and rises["held", 2] >= 0 and rises["free", 0] < 0
    assert np.mean((held.score(x[3000:]) > 0) == y[3000:]) > 0.75


def test_flat_nodes_equal_a_walk():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3))
    model = quality.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), [0, 0, 0], trees=20)

    def walk(row):
        total = model.start
        for node in model.roots:
            while model.child[node] != node:
                node = model.child[node] + int(row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return total

    assert np.allclose(model.score(x), [walk(r) for r in x])
    assert np.mean((model.score(x) > 0) == (x[:, 0] * x[:, 1] > 0)) > 0.9


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    stats = quality.document_stats(spark.read.parquet(f"{d}/documents.parquet"))
    x, y = quality.labelled_sample(stats, spark.read.parquet(f"{d}/labels.parquet"))
    cut = len(y) * 2 // 3
    right = (quality.fit(x[:cut], y[:cut]).score(quality.features(x[cut:])) >= 0) == y[cut:]
    assert len(y) > 300 and right.mean() > 0.97 and right[y[cut:] == 1].mean() > 0.98


def test_whole_table(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[10]), (10, TEXTS[10])]
    good = [(100 + k, " ".join(f"w{j * k % 97}{j}" for j in range(60)) + ".") for k in range(40)]
    bad = [(200 + k, " ".join(f"w{j * k % 97}{j}$$$" for j in range(60)) + "!!") for k in range(40)]
    docs = spark.createDataFrame(rows + good + bad, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("n_words", "score", "kept", "_y", "_of")})
    labels = spark.createDataFrame([(k, 1, None) for k in range(100, 130)] + [(k, 0, None) for k in range(200, 230)] + [(100, 1, None), (5, None, None), (None, 0, None)], "doc_id bigint, quality int, text string")
    out = quality.quality(docs, labels).select("doc_id", *quality.BASE, "base_failed", "kept").collect()
    want = sorted([[k is not None, k or 0, *base(t)] for k, t in rows + good + bad])
    assert sorted([r[0] is not None, r[0] or 0, *r[1:6]] for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] and r["doc_id"] >= 100:
            assert r["kept"] == (r["doc_id"] < 200)
    # no labels: all that pass the base rules are kept
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.quality(docs, labels.where("false")).collect())
    assert quality.quality(docs.where("false"), labels).collect() == []
