import base64
import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracal.operators.joins import ContractError, assert_contract
from veracal.operators.quality import contract_check
from veracal.operators.report import mean_of_means
from veracal.sources import readers as r, writers as w


def dump(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj))


def test_result_tree(spark, tmp_path):
    for seed, ece in ((1, 0.1), (2, 0.3)):
        dump(tmp_path / f"probe/m1/seed_{seed}/test/test_results.json", {"overall": {"ece": ece, "auroc": 0.5, "n_samples": 3}, "metadata": {}})
    dump(tmp_path / "probe/m2/seed_1/test/test_results.json", {"metrics": {"ece": 0.4, "note": "x"}})
    dump(tmp_path / "probe/m2/seed_2/test/test_results.json", "{broken")
    dump(tmp_path / "prompt/m1/final/test_metrics_and_results.json", {"overall": {"ece": 0.2}})
    dump(tmp_path / "probe/m1/final/test_metrics_and_results.json", {"overall": {"ece": 0.9}})
    rows = {(x["method"], x["vlm"], x["seed"], x["metric"]): x["value"] for x in r.read_main_results(spark, str(tmp_path)).collect()}
    assert rows == {
        ("probe", "m1", 1, "ece"): 0.1, ("probe", "m1", 1, "auroc"): 0.5, ("probe", "m1", 2, "ece"): 0.3, ("probe", "m1", 2, "auroc"): 0.5,
        ("probe", "m2", 1, "ece"): 0.4, ("prompt", "m1", None, "ece"): 0.2,
    }
    table = {x["method"]: x["ece"] for x in mean_of_means(r.read_main_results(spark, str(tmp_path)), ["method"]).collect()}
    assert table == {"probe": pytest.approx(0.3), "prompt": pytest.approx(0.2)}


def test_variant_tree(spark, tmp_path):
    dump(tmp_path / "abl/no_rank/m1/seed_1/test/test_results.json", {"overall": {"ece": 0.2}})
    dump(tmp_path / "main/probe/m1/seed_1/test/test_results.json", {"overall": {"ece": 0.1}})
    rows = {(x["variant"], x["vlm"], x["seed"]): x["value"] for x in r.read_variants(spark, f"{tmp_path}/abl", f"{tmp_path}/main/probe/..", "full").collect()}
    assert rows == {("no_rank", "m1", 1): 0.2, ("full", "m1", 1): 0.1}


def test_prediction_shapes(spark, tmp_path):
    records = [
        {"sample_id": "a", "confidence_score": 0.5, "ground_truth_correctness": 1},
        {"sample_id": "b", "confidence": 0.25, "label": False},
        {"sample_id": "c", "confidence": None, "label": 1},
        {"sample_id": "d", "confidence_score": 0.75},
    ]
    dump(tmp_path / "list.json", records)
    dump(tmp_path / "doc.json", {"samples": records})
    with gzip.open(tmp_path / "zipped.json.gz", "wt") as f:
        json.dump(records, f)
    for name in ("list.json", "doc.json", "zipped.json.gz"):
        got = sorted((x["sample_id"], x["c"], x["y"]) for x in r.read_predictions(spark, str(tmp_path / name)).collect())
        assert got == [("a", 0.5, 1), ("b", 0.25, 0)], name


def test_npz_samples(spark, tmp_path):
    h = np.arange(6, dtype=np.float16).reshape(2, 3)
    np.savez(tmp_path / "a.npz", hidden_states=h, is_correct=np.array(True))
    np.savez(tmp_path / "b.npz", hidden_states=h, is_correct=np.array(None, dtype=object))
    (tmp_path / "c.npz").write_bytes(b"junk")
    df = r.read_npz(spark, str(tmp_path))
    counts = r.sample_counts(df, error="error").first()
    assert (counts["n_used"], counts["n_unlabelled"], counts["n_unreadable"]) == (1, 1, 1)
    row = r.read_samples(df.where("error is null"), "last").first()
    assert (row["hash_id"], list(row["vector"]), row["label"]) == ("a", [3.0, 4.0, 5.0], 1)


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + b"\0" * 3 * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(7, 3))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = sorted((x["path"][-5:], x["width"], x["height"], x["ok"]) for x in r.image_dims(spark, str(tmp_path)).collect())
    assert rows == [("a.png", 7, 3, True), ("b.png", None, None, False)]
    blob = r.blob_dims(spark.createDataFrame([(bytearray(png(7, 3)),), (bytearray(b"x"),)], "i binary"), "i").collect()
    assert [(x["width"], x["height"], x["ok"]) for x in blob] == [(7, 3, True), (None, None, False)]


def headers():
    """Files of known size (width 300, height 70), each with the format's own header."""
    frame = b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", 70, 300) + bytes(10)
    comment = b"\xff\xfe" + struct.pack(">H", 60002) + b"x" * 60000
    vp8l = (299 | 69 << 14).to_bytes(4, "little")
    return {
        "png": png(300, 70), "gif": b"GIF89a" + struct.pack("<HH", 300, 70) + bytes(3), "bmp": b"BM" + bytes(16) + struct.pack("<ii", 300, -70),
        "jpeg": b"\xff\xd8\xff\xe0\x00\x04ab" + frame, "filled": b"\xff\xd8\xff\xff\xff\x01" + frame, "late": b"\xff\xd8" + comment * 3 + frame,
        "vp8x": b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (299).to_bytes(3, "little") + (69).to_bytes(3, "little"),
        "vp8": b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 300 | 1 << 14, 70),
        "vp8l": b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + vp8l + bytes(5),
    }


def test_sizes_of_all_formats(spark):
    good = headers()
    bad = {"scan": b"\xff\xd8\xff\xda\x00\x04ab", "cut": good["late"][:-12], "text": b"plain", "empty": b"", "none": None, "zero": b"GIF87a" + bytes(7), "short": good["png"][:20], "junk": b"\xff\xd8\x00\x11\x22\x33"}
    rows = [(k, None if v is None else bytearray(v), 1) for k, v in {**good, **bad}.items()]
    df = spark.createDataFrame(rows, "k string, i binary, width int").repartition(3)
    got = {x["k"]: (x["width"], x["height"], x["ok"]) for x in r.blob_dims(df, "i").collect()}
    assert got == {**{k: (300, 70, True) for k in good}, **{k: (None, None, False) for k in bad}}


def test_tsv_is_split_where_no_record_spans_lines(spark, tmp_path):
    assert [r.line_ends_open(x) for x in ('a\tb', '"a\tb', '"a"\t"b', '"a ""q"""\tx', 'a"b\t""', '"a\tb"', '"""', 'x\t"', "")] == [False, True, True, False, False, False, True, True, False]
    body = "".join(f'{i}\t"say ""{i}"" now"\tmid"dle\t{"A" * 400}\n' for i in range(3000))
    dump(tmp_path / "t.tsv", "id\tquoted\tplain\tblob\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = r.read_tsv(spark, str(tmp_path / "t.tsv"))
        assert df.rdd.getNumPartitions() > 3
        rows = df.collect()
        assert r.read_tsv(spark, str(tmp_path / "t.tsv"), multiline=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3000 and {(x["quoted"], x["plain"]) for x in rows} == {(f'say "{i}" now', 'mid"dle') for i in range(3000)}


def test_tsv_and_jsonl(spark, tmp_path):
    blob = base64.b64encode(bytes(range(200))).decode()
    dump(tmp_path / "t.tsv", f'question\timage\n"two\nlines"\t{blob}\n')
    row = r.read_tsv(spark, str(tmp_path / "t.tsv")).select("question", F.unbase64("image").alias("raw"), "image").first()
    assert (row["question"], bytes(row["raw"]), row["image"]) == ("two\nlines", bytes(range(200)), blob)
    dump(tmp_path / "q.jsonl", '{"question_id": 1, "text": "a"}\n{"question_id": 2, "text": "b"}\n')
    assert r.read_jsonl(spark, str(tmp_path / "q.jsonl")).count() == 2


def test_paraphrase_places(spark, tmp_path):
    dump(tmp_path / "one/a.json", {"hash_id": "a", "paraphrases": ["a1", "a2"]})
    dump(tmp_path / "one/b.json", {"hash_id": "b", "paraphrases": []})
    dump(tmp_path / "two/b.json", {"paraphrases": ["b1"]})
    dump(tmp_path / "map.json", {"c": "c1", "d": {"paraphrases": ["d1"]}, "e": ["e1"], "a": "zzz"})
    items = spark.createDataFrame([(x,) for x in "abcdef"], "hash_id string")
    got = r.first_paraphrase(
        items, r.read_paraphrases(spark, f"{tmp_path}/one"), r.read_paraphrases(spark, f"{tmp_path}/two"),
        r.read_paraphrase_mapping(spark, f"{tmp_path}/map.json"),
    )
    assert {x["hash_id"]: x["paraphrase"] for x in got.collect()} == {"a": "a1", "b": "b1", "c": "c1", "d": "d1", "e": "e1", "f": None}


def test_contract_file(spark, tmp_path):
    doc = {
        "splits": {"test": {"n_rows": 4, "unique_hash_ids": 2}}, "per_source": {"test": {"s": 2}},
        "per_split_model": {"test": {"m1": 2, "m2": 2}}, "per_split_model_source": {"test": {"m1": {"s": 2}}},
        "per_split_model_correctness": {"test": {"m1": 1, "m2": 9}},
    }
    dump(tmp_path / "c.json", doc)
    contract = r.read_contract(spark, str(tmp_path / "c.json"))
    assert contract.count() == 8
    rows = [("test", "m1", "s", "a", 1), ("test", "m1", "s", "b", 0), ("test", "m2", "s", "a", 1), ("test", "m2", "s", "b", 1)]
    df = spark.createDataFrame(rows, "split string, model_name string, dataset string, hash_id string, is_correct int")
    check = contract_check(df, contract)
    assert {(x["level"], x["model"]) for x in check.where("not ok").collect()} == {("model_correct", "m2")}
    with pytest.raises(ContractError):
        assert_contract(check)
    assert_contract(check.where("ok"))


def test_split_and_feature_sinks(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("x"))
    # blobs of 1 kB to 2 MB that do not compress, a null, and a nested column
    rng = np.random.default_rng(1)
    sizes = [1000] * 60 + [50_000] * 20 + [2_000_000] * 6
    rows = [(i, bytearray(rng.bytes(n)), [{"a": "x" * 50}]) for i, n in enumerate(rng.permutation(sizes))] + [(900, None, None)]
    blobs = spark.createDataFrame(rows, "k int, image binary, more array<struct<a:string>>").repartition(4)
    assert w.write_split(blobs, str(tmp_path / "s"), shard_bytes=5_000_000) == 87
    files = [p.stat().st_size for p in (tmp_path / "s").glob("*.parquet")]
    assert max(files) <= 5_000_000 and 3 <= len(files) <= 10
    assert sorted((x["k"], x["image"]) for x in spark.read.parquet(str(tmp_path / "s")).where("k < 900").collect()) == sorted(x[:2] for x in rows[:-1])
    assert w.write_split(blobs.where("false"), str(tmp_path / "e")) == 0 and spark.read.parquet(str(tmp_path / "e")).columns == blobs.columns
    w.save_features(df, str(tmp_path / "f"), ["k"], ["x"])
    assert spark.read.csv(str(tmp_path / "f/features.csv"), header=True).columns == ["k", "x"]
