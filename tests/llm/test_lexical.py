"""Lexical search against a count by regular expressions."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tools.check_oracle import connect, spark_rows, sql_rows
from veracal.llm import lexical, queries

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranks(docs, items, top=50):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, of in wanted.items():
        found = []
        for doc, c in held:
            m = 100 - 50 + 50 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in of if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(found)[:top], 1)]
    return out


def key(row):
    return [(v is not None, v or 0) for v in row]


def tables(spark):
    docs = [
        (1, "The quick brown fox; the lazy dog"), (2, "the the the"), (2, "the the the"), (3, None), (4, ""), (5, " ...\n\t"), (None, "fox É é ß İ 日本 日本語"),
        (6, "fox"), (7, "FOX fox Fox"), (8, "foxes oxen x0 9lives"), (9, "é" * 9 + " fox\x00dog\x7fÉ"), (10, "word " * 50_000 + "end"), (-3, "fox"),
    ] + [(100 + k, "copy of a copy") for k in range(70)]
    items = [(1, "Fox, dog; the THE fox"), (2, "日本 é É"), (3, None), (4, "..."), (5, "nothing here matches qqq"), (None, "copy word"), (6, "a copy"), (6, "of end"), (7, "x0 9lives ox")]
    return docs, items


def test_search_equals_counting(spark):
    docs, items = tables(spark)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x")).withColumn("n", F.lit("y")).withColumn("m", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("x")).withColumn("doc_id", F.lit("y"))
    want = sorted(ranks(docs, items), key=key)
    for block_bytes in (lexical.BLOCK_BYTES, 5000):
        got = [tuple(r) for r in lexical.ranked_search(d, i, block_bytes=block_bytes).collect()]
        assert sorted(got, key=key) == want
    assert len([r for r in want if r[0] == 6]) == 50 and any(r[2] is None for r in want)


def test_best_documents_survive_many_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_ROWS", 7)
    monkeypatch.setattr(lexical, "CELLS", 40)
    docs = [(k, " ".join(f"t{(k * j) % 11}" for j in range(1, 1 + k % 13))) for k in range(400)]
    items = [(k, f"t{k} t{k + 1} t{k * 2}") for k in range(8)]
    machine = lexical.automaton([f"t{j}" for j in range(17)])
    assert lexical.count_terms(b"T1 t1,t11 t2 t111", machine) == (5, Counter({1: 2, 11: 1, 2: 1}))
    best = lexical.Best(2, 3)
    best.limit = 5
    import numpy as np

    for at in range(0, 40, 4):
        ids = np.arange(at, at + 4)
        best.add(np.stack([ids % 5, ids * 0 + 1], axis=1), ids, ids < 0)
    item, score, _, ids = best.settle()
    assert list(zip(item, score, ids)) == [(0, 4, 4), (0, 4, 9), (0, 4, 14), (1, 1, 0), (1, 1, 1), (1, 1, 2)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, lexical.ranked_search(d, i, top=5).collect())) == sorted(ranks(docs, items, 5))


def test_empty_tables(spark):
    docs, items = tables(spark)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert lexical.ranked_search(d.where("false"), i).collect() == []
    assert lexical.ranked_search(d, i.where("false")).collect() == []


def test_search_equals_sql(spark, sf):
    name = "op12_automaton_search"
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(connect(sf), queries.ORACLES[name])
