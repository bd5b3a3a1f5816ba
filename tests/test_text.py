import pytest
from pyspark.sql import functions as F

from veracal.functions import keys as k, text as t

CONFIDENCE = [
    ("Confidence: 85%", 0.85), ("confidence: 85", 0.85), ("Confidence: 1", 1.0), ("Confidence: 0.4", 0.4),
    ("first 10% then 40 %", 0.4), ("I say 70 of 100", 1.0), ("I say 70 of 100 or 250", 1.0), ("250 300", None),
    ("none", None), ("", None), ("Confidence: 900", 1.0), ("x" * 300 + " 12", 0.12), ("12 " + "x" * 300, None), (None, None),
]


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("reply, want", CONFIDENCE)
def test_verbal_confidence(spark, reply, want):
    got = one(spark, reply, t.verbal_confidence)
    assert got is None if want is None else got == pytest.approx(want)


PARAPHRASES = [
    ("[question_1] A? [/question_1]\n[QUESTION_2]\nB\nC?[/question_2]", ["A?", "B\nC?"]),
    ("[question_1] A? [/question_2] [question_2] B?? ", ["A?", "B?"]),
    ("[question_1]A?[/question_1] [question_1] A [question_2] D", ["A?", "D?"]),
    ("1. A?\n 2) B?\nC?", ["A?", "B?"]),
    ("nothing", []),
]


@pytest.mark.parametrize("reply, want", PARAPHRASES)
def test_paraphrases(spark, reply, want):
    assert one(spark, reply, lambda c: t.paraphrases(c, 3)) == want


def test_paraphrases_are_cut(spark):
    text = "".join(f"[question_{i}] q{i}? [/question_{i}]" for i in range(1, 6))
    assert one(spark, text, lambda c: t.paraphrases(c, 3)) == ["q1?", "q2?", "q3?"]


@pytest.mark.parametrize(
    "text, want", [("yes", True), ("No.", False), ("I do not know", False), ("YES, no", False), ("maybe", False), (None, None)]
)
def test_judge(spark, text, want):
    assert one(spark, text, t.judge_yes_no) is want


@pytest.mark.parametrize("text", ["", " \t\n", "a", " a b c ", "x\x1cy", "tab\tsep\nline", " "])
def test_white_space_follows_python(spark, text):
    assert one(spark, text, t.word_count) == len(text.split())
    assert one(spark, text, k.strip) == text.strip()
    assert one(spark, text, k.na) == ("N/A" if not text.strip() else text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("{'a': 'x', 'detailed': 'relS', 'n': None}", "relS"), ("{'detailed': None}", None), ("{'detailed': 'a None, b'}", "a None, b"),
        ("[1, 2]", None), ("broken", None), (None, None), ('{"detailed": "it\'s"}', "it's"),
    ],
)
def test_dict_field(spark, text, want):
    assert one(spark, text, lambda c: k.dict_field(c, "detailed")) == want


@pytest.mark.parametrize("text, want", [("['a', 'b']", ["a", "b"]), ("['it', None]", ["it", None]), ("a, b", None), ("[]", [])])
def test_parse_list(spark, text, want):
    assert one(spark, text, k.parse_list) == want


def test_keys_equal_hashlib(spark):
    import hashlib

    row = ("GQ", None, " q\n", "ä", "\t")
    want = hashlib.md5("[SEP]".join(["GQ", "N/A", " q\n", "ä", "N/A"]).encode()).hexdigest()
    df = spark.createDataFrame([row], "a string, b string, c string, d string, e string")
    assert df.select(k.content_key(*[F.col(x) for x in "abcde"])).first()[0] == want
    seed = int.from_bytes(hashlib.sha256(b"id_salt").digest()[:4], "big") ^ 42
    assert one(spark, "id", lambda c: k.row_seed(c, 42, "salt")) == seed


def test_mc_question_and_letter(spark):
    df = spark.createDataFrame([(" q ", "Cat", "dog", "a bird", "fish", "None", " CAT "), ("q", "x", "y", "z", "w", "bird", "big bird")],
                               "q string, a string, b string, c string, d string, e string, t string")
    opts = [F.col(x) for x in "abcde"]
    rows = df.select(k.mc_question(F.col("q"), opts).alias("m"), k.answer_letter(F.col("t"), opts).alias("l")).collect()
    assert rows[0]["m"] == "q\nA) Cat\nB) dog\nC) a bird\nD) fish" and rows[0]["l"] == "A"
    assert rows[1]["m"].endswith("\nE) bird") and rows[1]["l"] == "E"
