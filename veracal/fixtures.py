"""Inputs derived from the given tables, as DataFrames and as equal SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.keys import SEP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods x models x seeds with ties at 1.0 and one single-class dataset."""
    sample = F.expr("event_id div 5")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "value", sample.alias("sample_id"))
        .where(~((F.col("event_id") % 5 == 2) & (F.col("sample_id") % 11 == 0)))
        .withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(5))))
        .select(
            "sample_id",
            F.concat(F.lit("m"), F.col("event_id") % 5).alias("method"),
            F.concat(F.lit("v"), F.col("sample_id") % 5).alias("vlm"),
            "seed",
            F.concat(F.lit("d"), F.col("sample_id") % 7).alias("dataset"),
            F.concat(F.lit("c"), F.col("sample_id") % 4).alias("category"),
            F.when((F.col("sample_id") % 7 == 6) | ((F.col("sample_id") * 7) % 3 == 0), 1).otherwise(0).alias("y"),
            F.least(
                F.greatest(F.col("value") / F.lit(100.0) + (F.col("seed") - 3) * F.lit(0.01), F.lit(0.0)), F.lit(1.0)
            ).alias("c"),
        )
    )


P_SQL = """select cast(floor(event_id / 5) as bigint) as sample_id,
  concat('m', cast(event_id % 5 as varchar)) as method,
  concat('v', cast(cast(floor(event_id / 5) as bigint) % 5 as varchar)) as vlm,
  s.seed as seed,
  concat('d', cast(cast(floor(event_id / 5) as bigint) % 7 as varchar)) as dataset,
  concat('c', cast(cast(floor(event_id / 5) as bigint) % 4 as varchar)) as category,
  case when cast(floor(event_id / 5) as bigint) % 7 = 6 then 1
       when (cast(floor(event_id / 5) as bigint) * 7) % 3 = 0 then 1 else 0 end as y,
  greatest(least(value / cast(100 as double) + (s.seed - 3) * cast(0.01 as double), cast(1 as double)), cast(0 as double)) as c
from events cross join (select unnest([1, 2, 3, 4, 5]) as seed) s
where not (event_id % 5 = 2 and cast(floor(event_id / 5) as bigint) % 11 = 0)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero confidences and heavy ties."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("g"),
        (F.col("l_discount") * 10).alias("c"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
    )


SCORES_SQL = """select l_linestatus as g, l_discount * 10 as c,
  case when l_returnflag = 'R' then 1 else 0 end as y from lineitem"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with duplicate content and overlapping splits."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("row_idx"),
        F.col("source").alias("dataset"),
        F.col("lang").alias("category"),
        F.col("text").alias("question"),
        F.md5(F.concat_ws(SEP, F.lit("doc"), F.col("lang"), F.col("text"))).alias("hash_id"),
        F.when(doc % 10 < 7, "train").when(doc % 10 == 7, "validation").otherwise("test").alias("split"),
    )


ITEMS_SQL = """select doc_id as row_idx, source as dataset, lang as category, text as question,
  md5(concat_ws('[SEP]', 'doc', lang, text)) as hash_id,
  case when doc_id % 10 < 7 then 'train' when doc_id % 10 = 7 then 'validation' else 'test' end as split
from documents"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn with the assistant turn that follows."""
    turns = table(spark, sf_dir, "conversations")
    u = turns.where(F.col("role") == "user")
    a = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.md5("text").alias("hash_id"), F.col("text").alias("question"), "response"
    )


OUTPUTS_SQL = """select u.conv_id as conv_id, u.turn as turn, md5(u.text) as hash_id, u.text as question, a.text as response
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies for every parsing pass, and unparsable ones."""
    whole = F.floor("value").cast("bigint")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("Confidence: "), whole, F.lit("%")))
        .when(kind == 1, F.concat(F.lit("first 10% then "), whole % 100, F.lit(" % sure")))
        .when(kind == 2, F.concat(F.lit("I would say "), whole, F.lit(" out of 100")))
        .when(kind == 3, F.concat(F.lit("confidence:0."), F.col("event_id") % 10))
        .otherwise(F.lit("no idea at all"))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), text.alias("reply"), "event_type")


REPLIES_SQL = """select event_id as sample_id,
  case event_id % 5
    when 0 then concat('Confidence: ', cast(cast(floor(value) as bigint) as varchar), '%')
    when 1 then concat('first 10% then ', cast(cast(floor(value) as bigint) % 100 as varchar), ' % sure')
    when 2 then concat('I would say ', cast(cast(floor(value) as bigint) as varchar), ' out of 100')
    when 3 then concat('confidence:0.', cast(event_id % 10 as varchar))
    else 'no idea at all' end as reply, event_type
from events"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sample_id"),
        F.col("p_brand").alias("dataset"),
        (200 + F.col("p_size") * 90).cast("bigint").alias("width"),
        (150 + (F.col("p_partkey") % 50) * 100).cast("bigint").alias("height"),
    )


SIZES_SQL = """select p_partkey as sample_id, p_brand as dataset,
  cast(200 + p_size * 90 as bigint) as width, cast(150 + (p_partkey % 50) * 100 as bigint) as height from part"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch scores per trial; the epoch is the position of an event of its user."""
    from .operators.ordered import running

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 500.0).alias("score"))
    placed = running(events, ["user_id"], ["ts", "event_id"], {"_n": ("sum", F.lit(1).cast("bigint"))})
    return placed.select(F.col("user_id").alias("trial"), (F.col("_n") - 1).alias("epoch"), "score", "event_id")


HISTORY_SQL = """select user_id as trial, row_number() over (partition by user_id order by ts, event_id) - 1 as epoch,
  value / cast(500 as double) as score, event_id from events"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-way logits as the token steps of a sample."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 8").alias("sample_id"),
        (F.col("vec_id") % 8).alias("token_idx"),
        F.col("label").alias("token_id"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


TOKENS_SQL = """select cast(floor(vec_id / 8) as bigint) as sample_id, vec_id % 8 as token_idx, label as token_id,
  cast(embedding as double[]) as logits from embeddings"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base view and the blank view paired with it."""
    emb = table(spark, sf_dir, "embeddings")
    blank = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("h_blank"))
    return emb.join(blank, "vec_id").select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("h_base"),
        "h_blank",
        F.when(F.col("label") < 5, 1).otherwise(0).alias("y"),
        F.when(F.col("vec_id") % 10 == 0, 0).otherwise(1).alias("mask"),
    )


VIEWS_SQL = """select b.vec_id as sample_id, cast(b.embedding as double[]) as h_base, cast(k.embedding as double[]) as h_blank,
  case when b.label < 5 then 1 else 0 end as y, case when b.vec_id % 10 = 0 then 0 else 1 end as mask
from embeddings b join embeddings k on k.vec_id = b.vec_id + 1"""


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output matrix: one mean vector per label, so a token id names its row."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # 64 dimensions per label, whatever the number of vectors
    return means.groupBy(F.col("label").alias("row")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("w")
    )


W_SQL = """select label as "row", list(m order by i) as w from (
  select label, i, avg(cast(embedding[i + 1] as double)) as m
  from embeddings, (select unnest(range(64)) as i) group by label, i) group by label"""
