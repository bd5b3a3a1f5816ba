"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from veracal.llm import chat, langid, mixing, neardup, pieces, pii, repeats, sharding, simhash, topk
from veracal.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def docs(spark):
    base = prose(1, 120)
    rows = [(i, prose(i), "en", f"s{i % 3}", 1) for i in range(10, 40)]
    rows += [
        (1, base, "en", "s0", 1), (2, base, "en", "s1", 1), (3, base + " omega", "en", None, 1), (2, base, "en", "s1", 1),
        (4, None, None, None, None), (5, "", "en", "s0", 0), (6, "  \n\t", "en", "s1", 3), (None, base, "en", "s2", 1),
        (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich " * 400, "de", "s2", 1),
        (8, "mail a.b7@x.org or A.B7@X.ORG, call +1 (017) 555-7713 and +1 017 555 7713, pay 4111 1111 1111 1111", "en", "s0", 1),
        (9, "Mrs. Mary Keller met Mr John Smith; Mr Smith logged in from 10.1.2.3 and 8.8.8.8", "en", "s0", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """The input with columns named like the operators' own."""
    for name in ("size", "fp", "node", "root", "key", "id", "rank", "_nth", "n_entities", "ids"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def test_surrogates_never_run_out():
    for kind, value in (("ip", "192.168.3.4"), ("ssn", "123456789"), ("phone", "+15550100"), ("card", "4111111111111111"), ("secret", "AKIA" + "A" * 16)):
        drawn = {pii.surrogate(kind, value, "k", a) for a in range(60)}
        assert len(drawn) > 50 and max(map(len, drawn)) > len(value)
    ranges = {"10.1.2.3": "10.", "127.0.0.1": "127.", "172.20.1.1": "172.", "192.168.0.9": "192.168.", "169.254.1.1": "169.254."}
    assert all(pii.surrogate("ip", v, "k").startswith(head) for v, head in ranges.items())
    assert 16 <= int(pii.surrogate("ip", "172.20.1.1", "k").split(".")[1]) <= 31
    assert pii.written("555-0100", "phone", "123456789") == "123-456789"


TAKEN = ["_k1", "_k2", "_c1", "_c2", "_nth", "_h1", "_h2", "_map", "_new", "_group", "node", "bucket"]


@pytest.mark.parametrize("stage", [simhash.keep_one, pii.replace_entities, langid.accepted_documents])
def test_columns_of_any_name_keep_their_values(spark, stage):
    df = docs(spark).withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in TAKEN})
    out = stage(df).collect()
    assert out and all(r[name] == (None if r.doc_id is None else f"{name}{r.doc_id}") for r in out for name in TAKEN)


def empty(df):
    return df.where(F.lit(False))


def test_sharding(spark):
    df = with_clashes(docs(spark))
    out = sharding.shard_by_size(df, shards=4, ranges_per_shard=64).collect()
    want = sorted((len((r.text or "").encode()) + 1) for r in df.collect())
    assert sorted(r["size"] for r in out) == want
    crc = {r.doc_id: None if r.text is None else zlib.crc32(r.text.encode()) for r in df.collect() if r.doc_id}
    assert all(r.text_crc32 == crc[r.doc_id] for r in out if r.doc_id)
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_size(empty(df)).collect() == []


def test_sharding_divides_a_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    by = {r.shard: r.b for r in sharding.shard_by_size(df, shards=4, ranges_per_shard=64).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(by) == 4 and max(by.values()) < 1.1 * min(by.values())


@pytest.mark.parametrize("rounds", [2, 12])
def test_sharding_when_rounds_run_out(spark, rounds, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_ROUNDS", rounds)
    long = F.when(F.col("id") % 200 == 0, F.repeat(F.lit("x"), 40000)).otherwise(F.lit(""))
    df = spark.range(12000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")), long).alias("text"))
    out = sharding.shard_by_size(df, shards=4, ranges_per_shard=64).collect()
    by = [[r for r in out if r.shard == s] for s in range(4)]
    assert sum(map(len, by)) == len(out) == 12000
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by)
    sizes = [sum(r["size"] for r in part) for part in by]
    assert max(sizes) - min(sizes) < 3 * 40010


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(300, rows[0][1]), (7, rows[1][1]), (301, None), (302, []), (303, [float("nan")] * 16), (304, [None] * 16), (305, [1.0, 2.0]), (None, rows[2][1]), (306, [1e30] * 16)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.exact_topk(df, F.col("vec_id") % 50 == 0, block_rows=64, block_queries=3, seeds=8).collect()
    q = lambda v: [int(np.floor(256 * x)) for x in v]
    good = [(n, i, q(v)) for n, (i, v) in enumerate(rows) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    for n, i, v in good:
        if i is not None and i % 50 == 0:
            score = sorted((-clip(sum(a * b for a, b in zip(v, w))), 1 << 63 if j is None else j, m) for m, j, w in good if m != n)[:5]
            assert sorted((r["rank"], r.score) for r in got if r.query_id == i) == [(k + 1, -s[0]) for k, s in enumerate(score)]
    assert topk.exact_topk(empty(df), F.lit(True)).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}}


def sim(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("dense", [1, 512])
def test_simhash(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    df = with_clashes(docs(spark))
    rows = [(r.doc_id, sim(r.text, 3)) for r in df.collect()]
    name = {}
    for i, f in rows:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for _, y in rows:
                if y not in seen and bin(x ^ y).count("1") <= 2:
                    seen.add(y)
                    todo.append(y)
        name[f] = min(j for j, y in rows if y in seen and j is not None)
    got = simhash.simhash_groups(df).collect()
    assert sorted(map(str, [(r.doc_id, r.fingerprint, r.component_id) for r in got])) == sorted(str((i, f"{f:016x}", name[f])) for i, f in rows)
    assert simhash.simhash_groups(empty(df)).collect() == []


def test_near_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 40)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4)}
    got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def plan_of(df):
    """Rows, and the plan that ran in the end."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("segments, radius", [(2, 2), (3, 3)])
def test_near_links_broadcast_no_exploded_rows(spark, tmp_path, segments, radius):
    # read from a file, so that Spark has a size for the prints, which it takes for that of the exploded rows
    base = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 300)
    prints = {int(b) ^ flip for b in base for flip in (0, 3, 7)}
    spark.createDataFrame([(p,) for p in prints], "fp bigint").write.parquet(str(tmp_path / "prints"))
    got, plan = plan_of(simhash.near_links(spark.read.parquet(str(tmp_path / "prints")), radius, segments))
    apart = (3, 4, 7)[:radius]
    assert sorted((r.a, r.b) for r in got) == sorted((a, a ^ x) for a in prints for x in apart if a ^ x in prints and a < a ^ x)
    assert "Generate" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_simhash_groups_broadcast_no_documents(spark):
    # few fingerprints: the file of the documents is far smaller than their rows
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id") % 7).alias("text"))
    got, plan = plan_of(simhash.simhash_groups(df))
    assert len(got) == 3000 and all(r.component_id <= r.doc_id for r in got)
    assert "Join" in plan and "SortMergeJoin" in next(line for line in plan.splitlines() if "Join" in line)


def test_keep_one(spark):
    df = with_clashes(docs(spark))
    left = simhash.keep_one(df)
    assert left.columns == df.columns
    ids = sorted((r.doc_id for r in left.collect()), key=str)
    # copies, the near copy and the repeated row go; of the texts without words the first stays
    assert ids == sorted([1, 4, 7, 8, 9, *range(10, 40)], key=str)
    assert simhash.keep_one(empty(df)).collect() == []


def test_short_texts_are_not_folded_together(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("only "), F.col("id").cast("string")).alias("text"))
    assert simhash.keep_one(df).count() == 6000


@pytest.mark.parametrize("block", [3, 256])
def test_keep_one_equals_exact_jaccard(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "SET_ROWS", block)
    rng, rows = np.random.default_rng(3), []
    for k in range(150):  # pairs of one changed stretch each, from about 0.7 to 0.95, and chains of them
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for step in range(1 + k % 4):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            at, n = int(rng.integers(10, 150)), int(rng.integers(1, 35))
            words = words[:at] + [f"x{x}" for x in rng.integers(0, 5000, n)] + words[at + n:]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    group = list(range(len(rows)))
    near = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            j = both / (len(sets[a]) + len(sets[b]) - both)
            near += 0.7 <= j < 0.9
            if j >= 0.8:
                group = [group[a] if g == group[b] else g for g in group]
    assert near > 50
    want = sorted(min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group))
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == want


def test_bits_are_majorities():
    h = np.random.default_rng(6).integers(0, 1 << 63, 600, dtype=np.uint64)
    bits = simhash._bits(h, 700)
    alone = np.array([simhash._bits(h[k:k + 1], 700) for k in range(len(h))])
    assert len(bits) == 700 and (bits == (2 * alone.sum(0) > len(h))).all()
    assert abs(np.corrcoef(alone[:, ::7].T)[np.triu_indices(100, 1)]).max() < 0.25


@pytest.mark.parametrize("block", [8, 64])
def test_balls_find_pairs_at_the_similarity(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 100)
    monkeypatch.setattr(simhash, "PRINT_ROWS", block)
    assert simhash._layout(450) == ((8, 7) if block == 8 else (8, 4))
    rows, want = [], set()
    for k in range(150):
        n = (4, 8, 12, 20, 40, 100)[k % 6]  # shingles of the shorter text, a part of the longer: 0.8 at least, and just below
        words = [f"w{k}x{i}" for i in range(n * 5 // 4 + 5)]
        want |= {3 * k, 3 * k + 2}
        rows += [(3 * k, " ".join(words[:n + 4])), (3 * k + 1, " ".join(words[:n * 5 // 4 + 4])), (3 * k + 2, " ".join(words[2:4] + words))]
    left = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()

    def shingles(t):
        return {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}

    text, expect = dict(rows), set()
    for k in range(150):
        a, b, c = (shingles(text[3 * k + i]) for i in range(3))
        assert len(a & b) / len(a | b) == 0.8
        expect |= {3 * k} if len(b & c) / len(b | c) >= 0.8 else {3 * k, 3 * k + 2}
    assert {r.doc_id for r in left} == expect and expect < want


def test_pairs_of_a_tile():
    import pandas as pd

    rng = np.random.default_rng(7)
    n, width = 400, 3
    base = rng.integers(-(1 << 63), (1 << 63) - 1, (4, 4))
    prints = base[rng.integers(0, 4, n)] ^ (np.int64(1) << rng.integers(0, 63, (n, 4))) ^ (np.int64(1) << rng.integers(0, 63, (n, 4))) * (rng.random((n, 4)) < 0.4)
    rows = pd.DataFrame(prints, columns=simhash.PRINTS).assign(
        bucket=np.sort(rng.integers(0, 2, n)), _i=0, _j=1, _side=rng.integers(0, 2, n), node=np.arange(n),
        low=rng.integers(0, 1 << width, n), few=rng.random(n) < 0.5,
    ).sort_values("bucket")
    work = simhash._candidates(width, [(2, 6), (3, 8)])
    got = {(a, b) for out in work([rows[:150], rows[150:170], rows[170:]]) for a, b in zip(out["a"], out["b"])}
    group = list(range(n))
    at = rows.to_dict("records")
    for x in range(n):
        for y in range(x):
            p, q = at[x], at[y]
            differ = bin(p["low"] ^ q["low"]).count("1")
            met = p["bucket"] == q["bucket"] and p["_side"] != q["_side"] and differ <= 1
            far = [bin((p[f] ^ q[f]) & (1 << 64) - 1).count("1") for f in simhash.PRINTS]
            if met and (far[0] <= 3 and sum(far) <= 8 if p["few"] and q["few"] else far[0] <= 2 and sum(far) <= 6):
                a, b = group[p["node"]], group[q["node"]]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert {frozenset(p) for p in got} == {frozenset((k, g)) for k, g in enumerate(group) if k != g}
    assert len(got) > 50


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=8) * 0.25 * (i % 3)], i % 12 % 2) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("inf")] * 8, 1), (205, [None] * 8, 1), (206, [1.0], 0), (0, rows[0][1], 0)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    ok = lambda r: r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))
    n = len(rows)
    link = [[bool(a != b and ok(rows[a]) and ok(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= 0.93) for b in range(n)] for a in range(n)]
    want = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            todo += [b for b in range(n) if link[x][b] and b not in seen]
            seen |= {b for b in range(n) if link[x][b]}
        c = min(rows[b][0] for b in seen)
        want.append((rows[a][0], sum(link[a]), c, rows[a][0] == c))
    got = neardup.near_vectors(df, block_rows=7).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(want)
    assert neardup.near_vectors(empty(df)).collect() == []


def test_mixing(spark):
    df = with_clashes(docs(spark))
    out = mixing.mix(df, block_rows=8).collect()
    assert len(out) == df.count() and sorted(map(str, out)) == sorted(map(str, mixing.mix(df, block_rows=8).collect()))
    assert all(r.taken <= 2 * r["size"] for r in out)
    targets = {r.source: (r.target, r.source_size) for r in out}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * sum(r["size"] for r in out))
    assert all(t <= 2 * s + 1e-6 for t, s in targets.values())
    whole = mixing.mixed(df, block_rows=8)
    assert whole.columns == df.columns and whole.count() == sum(r.copies for r in out)
    assert mixing.mix(empty(df)).collect() == []


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(5)
    p, size = rng.random(200), rng.integers(1, 500, 200).astype(float)
    moved = mixing._move(p, size, rng.random(200))
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(p.sum()) and moved @ size == pytest.approx(p @ size)


@pytest.mark.parametrize("dense", [0, 2000])
def test_repeats(spark, dense, monkeypatch):
    monkeypatch.setattr(repeats, "DENSE", dense)
    passage = "one passage that many documents share, with other words on either side of it"
    more = [(1000 + i, f"{i} {'z' * i} {passage} {'y' * (i % 3)}{i}", f"s{i}") for i in range(300)]
    # long runs of one byte, of two and of few letters: one anchor at many places, pieces cut by their number of windows
    more += [(2000 + i, t, "s") for i, t in enumerate(["a" * 700, "b" + "a" * 90, "a" * 49, "ab" * 300, "ba" * 80 + "c", "a" * 60 + "ab" * 40, "\u00e9a" * 60])]
    shared = docs(spark).where("doc_id is not null")
    df = with_clashes(shared.unionByName(spark.createDataFrame(more, "doc_id bigint, text string, source string"), allowMissingColumns=True))
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(i, first.get(b[k:k + 50], i))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = repeats.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert any(w[2] for w in want)
    # maps that let everything through change no result
    monkeypatch.setattr(repeats, "bit_map", lambda keys, bits=0: np.full(1 << 15, 255, np.uint8))
    assert sorted(map(str, repeats.remove_repeats(df).collect())) == sorted(map(str, got))
    nulls = docs(spark).where("doc_id is null or doc_id in (1)")
    assert {r.n_removed for r in repeats.remove_repeats(nulls).collect()} == {0}
    assert repeats.remove_repeats(empty(df)).collect() == []


def test_chat_escape_and_tree(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\n", "<\\|x \\ [\\\\INST]", "", None, "plain [1] <b>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)] + [(1, 1, "assistant", "tie"), (None, 0, None, "x"), (2, None, "system", "only")]
    messages = chat.linear(with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    out = chat.formatted(messages, chat.paths(messages)).withColumn("read", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    key = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] is not None, r[3])
    for r in out:
        own = sorted((x for x in rows if x[0] == r.tree), key=key)
        assert [(t.role, t.text) for t in r.read] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
    tree = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 9.0), (2, 5, 6, "user", "x", 0.0), (2, 6, 5, "user", "y", 0.0), (2, 7, 6, "user", "z", None)], "tree bigint, id bigint, parent bigint, role string, text string, score double")
    best = chat.paths(tree, keep=1).orderBy("pos").collect()
    assert [(r.leaf, r.id) for r in best] == [(4, 1), (4, 2), (4, 4)]
    assert chat.paths(tree).select("leaf").distinct().count() == 2
    assert chat.formatted(empty(tree), chat.paths(empty(tree))).collect() == []


def test_pii(spark):
    df = with_clashes(docs(spark).drop("n_entities"))
    out = {r.doc_id: r for r in pii.replace_entities(df, length="n_chars").collect()}
    assert out[1].text == prose(1, 120) and out[4].text is None and out[5].text == ""
    text = out[8].text
    mails, phones = re.findall(r"\S+@\S+?(?=[, ]|$)", text), re.findall(r"\+1 \(?\d{3}\)? \d{3}[- ]\d{4}", text)
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() and "x.org" not in text.lower()
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "555-7713" not in text and pii._luhn(re.sub(r"\D", "", text[-19:])) == 0
    names = re.match(r"Mrs\. (\w+) ([\w-]+) met Mr (\w+) ([\w-]+); Mr ([\w-]+) logged in from 10\.", out[9].text)
    assert names and names[1] in pii.GIVEN["f", "latin"] and names[3] in pii.GIVEN["m", "latin"] and names[4] == names[5] != names[2]
    assert out[9].n_chars == len(out[9].text) and pii.replace_entities(empty(df)).collect() == []


def test_pii_whole_entities(spark):
    gone = {
        "Mr McDonald left": ["McDonald", "Donald"], "Dr. O'Neil left": ["O'", "Neil"], "Herr Dvořák und": ["Dvo", "řák"],
        "Frau Mary Jane Watson ging": ["Jane", "Watson"], "Mary Jane Watson left": ["Jane", "Watson"], "Mr J. Smithers left": ["J.", "Smithers"],
        "Mr. Mark Brownlow came. Later Mark Brownlow and BROWNLOW spoke; Brownlow's car": ["Mark", "Brownlow", "BROWNLOW"],
        "Prof. Dr. Vogelsang": ["Vogelsang"], "Herr von Braunau": ["Braunau"], "Mr SMITHERS": ["SMITHERS"],
        "call +14155552671 now": ["4155552671"], "call +33 6 12 34 56 78": ["12 34", "56 78"], "call 06 12 34 56 78": ["12 34", "56 78"],
        "from 2001:db80:0:0::1f and fe80::1:": ["db80", "fe80"], "mapped ::ffff:10.20.30.40 x": ["ffff", "20.30"], "face:cafe::beef": ["face", "beef"],
        "هاتف ٠١٧٤ ٥٥٥ ٧٧١٣": ["٥٥٥", "٧٧١٣"],
    }
    df = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(gone)], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: r for r in pii.replace_entities(df, length="n_chars").collect()}
    for k, (text, parts) in enumerate(gone.items()):
        assert not [p for p in parts if p in out[k].text], (text, out[k].text)
    again = re.fullmatch(r"Mr\. (\S+) (\S+) came\. Later (\S+) (\S+) and (\S+) spoke; (\S+)'s car", out[6].text)
    assert again[1] == again[3] and again[2] == again[4] == again[5] == again[6]
    hinted = {r.doc_id for r in df.where(F.col("text").rlike(pii.HINT)).collect()}
    assert hinted >= {k for k, text in enumerate(gone) if pii.FINDER.search(text)}
    assert pii.entities("at 12:30:45 from aa:bb:cc:dd:ee:ff") == []


def test_surrogates_are_distinct(spark):
    found = spark.createDataFrame([("given-f-latin", f"name{i}") for i in range(60)] + [("given-f-latin", "mary"), ("ssn", "123456789")], "kind string, value string")
    table = pii.surrogate_table(found).collect()
    assert len(table) == 62 == len({(r.kind, r.surrogate) for r in table})
    assert not {r.surrogate.lower() for r in table} & {r.value for r in table}


def test_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(table, spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert np.mean([r.language == r.declared for r in out]) > 0.97
    odd = spark.createDataFrame([(900001, None, None, None, 1), (900002, "", "en", "s", 1), (900003, "123 456", "en", "s", 1)], SCHEMA)
    left = langid.accepted_documents(table.unionByName(odd))
    assert left.columns == table.columns and left.count() == table.count()
    assert langid.accepted_documents(empty(table)).collect() == []


def test_held_out_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    languages, model = langid.fit_text_model(table.where("doc_id % 2 = 0"), "text", "lang", "doc_id")
    rest = langid.from_documents(table.where("doc_id % 2 = 1")).withColumn("declared", F.lit(None).cast("string")).withColumn("host", F.lit(None).cast("string"))
    got = {r.doc_id: r.language for r in langid.fuse(rest, languages, model).collect()}
    assert np.mean([got[r.doc_id] == r.lang for r in table.where("doc_id % 2 = 1").collect()]) > 0.95


def test_all_labels_are_fitted(spark, monkeypatch):
    # 70 labels, the rare ones in scripts of their own
    rows = [(k * 10 + i, " ".join(chr(0x4E00 + 60 * k + (7 * i + j) % 50) for j in range(40)), f"l{k:02}", "s", 1) for k in range(70) for i in range(6 if k < 64 else 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    languages, model = langid.fit_text_model(df, "text", "lang", "doc_id")
    assert len(languages) == 70
    got = {r.doc_id: (r.language, r.accepted) for r in langid.identify(df).collect()}
    assert got == {r[0]: (r[2], True) for r in rows}
    monkeypatch.setattr(langid, "DENSE_LANGUAGES", 70)
    dense = langid.fit_text_model(df, "text", "lang", "doc_id")[1]
    grams = langid._grams(rows[0][1])
    assert np.allclose(model.sums(grams), dense[:, grams].sum(1, dtype=np.float64), rtol=1e-5)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    m, lib = pieces.Model(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = np.random.default_rng(2)
    hard = ["", " ", "a  b", "a" * 2000, " x ", "日本語", "\U0001F600", "<s>", "=" * 70, "\n\n\t", "".join(rng.choice(list("theran "), 3000)), "".join(rng.choice(list("theran"), 3000)), *[prose(i) for i in range(5)]]
    for text in hard:
        assert m.encode(text).tolist() == lib.encode(text)
        assert m.decode(m.encode(text).tolist()) == text
    df = with_clashes(docs(spark))
    rows = pieces.tokenized(df).collect()
    assert len(rows) == df.count() and all(r.round_trip in (True, None) for r in rows) and {r.n_tokens for r in rows if r.doc_id == 4} == {None}
    assert pieces.tokenized(empty(df)).collect() == []


def test_pipeline(spark):
    table = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, "")
        assert stage(spark, empty(table), "").collect() == []
        if name != "tokens":
            assert out.columns == table.columns
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.language(spark, table, ""), "").collect()}
    assert kept == {1, 7, 8, 9, *range(10, 40)}


def test_windows_are_told_by_their_surroundings():
    text = np.random.default_rng(4).integers(97, 99, 4000).astype(np.uint8).tobytes() + b"a" * 300 + b"ab" * 90
    text += text[500:900]
    key = repeats.anchors(text, 50)
    at, beside = repeats.surroundings(np.frombuffer(text, np.uint8), np.arange(len(key)), key, 50)
    told = list(zip(key.tolist(), at.tolist(), *beside.T.tolist()))
    windows = [text[k:k + 50] for k in range(len(key))]
    assert len(set(told)) == len(set(windows)) == len(set(zip(told, windows)))


def test_runs_are_cut():
    anchor = np.repeat(np.array([5, 6, 7], np.uint64), [70, 3, 32])
    starts, ends = repeats._runs(anchor != 6, anchor)
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 32), (32, 64), (64, 70), (73, 105)]


def test_anchors_by_parts():
    data = np.random.default_rng(5).integers(97, 101, 3000).astype(np.uint8).tobytes()
    assert (repeats.anchors(data, 50) == repeats.anchors(data, 50, part=700)).all()
