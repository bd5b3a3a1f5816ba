import pytest
from pyspark.sql import functions as F

from veracal.functions.keys import answer_letter
from veracal.operators import joins as j


def test_repeated_keys_do_not_multiply_rows(spark):
    items = spark.createDataFrame([("k", 1), ("k", 2), (None, 3)], "hash_id string, v int")
    outputs = spark.createDataFrame([("k", True), (None, True)], "hash_id string, is_correct boolean")
    assert [tuple(r) for r in j.join_outputs(items, outputs).collect()] == [("k", 1, 2)]
    assert j.join_outputs(items.withColumn("at", -F.col("v")), outputs, order=["at"]).first()["v"] == 1
    df = spark.createDataFrame([("k", None), ("x", 7)], "hash_id string, v int")
    assert sorted(r["v"] for r in j.override(df, items, "hash_id", "v").collect()) == [2, 7]
    assert sorted(r["v"] for r in j.fallback(df, items, "hash_id", "v").collect()) == [2, 7]


def test_failing_contract_says_how_much(spark):
    check = spark.range(25).select("id", (F.col("id") < 2).alias("ok"))
    with pytest.raises(j.ContractError, match="and 3 more"):
        j.assert_contract(check)
    assert j.assert_contract(check.where("ok")).count() == 2


def test_missing_answer_has_no_letter(spark):
    df = spark.createDataFrame([(None, "Lung"), ("lung", "Lung")], "t string, a string")
    got = [r[0] for r in df.select(answer_letter(F.col("t"), [F.col("a")])).collect()]
    assert got == [None, "A"]
