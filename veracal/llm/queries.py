"""One query for each operator, over its whole table, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, langid, lexical, mixing, neardup, pieces, pii, quality, repair, repeats, sharding, simhash, topk
from .common import source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op3_sampled_splitters")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_by_size(source(spark, d, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_cube_mixing")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(source(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


EXTRA_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

OP9_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(17 + length(role) + length(regexp_replace(text, '([<\[]\\*)(\||/?s>|/?INST\])', '\1\\\2', 'g'))) as bigint) as formatted_chars
from rows group by conv_id"""


@query("op9_reply_trees", OP9_SQL)
def op9(spark: SparkSession, d: str) -> DataFrame:
    table = source(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    turns = table.unionByName(spark.createDataFrame(EXTRA_TURNS, table.schema))
    messages = chat.linear(turns)
    out = chat.formatted(messages, chat.paths(messages)).withColumn("read", chat.parsed(F.col("formatted")))
    said = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""


@query("op4_exact_topk", OP4_SQL)
def op4(spark: SparkSession, d: str) -> DataFrame:
    return topk.exact_topk(source(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_simhash_groups")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_groups(source(spark, d, "documents"))


OP10_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
reach as (
  select vec_id as a, vec_id as b from embeddings
  union select r.a, l.b from reach r join links l on r.b = l.a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, c as component_id, vec_id = c as kept
from embeddings join (select a, min(b) as c from reach group by a) on a = vec_id
left join (select a as la, count(*) as n from links group by a) on la = vec_id"""


@query("op10_near_vectors", OP10_SQL)
def op10(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_vectors(source(spark, d, "embeddings"))


@query("op1_surrogates")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return pii.replace_entities(source(spark, d, "documents"), length="n_chars")


@query("op2_language_fusion")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(source(spark, d, "documents"), source(spark, d, "pages"))


@query("op6_streaming_viterbi")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return pieces.tokenized(source(spark, d, "documents").select("doc_id", "text"))


@query("op8_repeated_passages")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(source(spark, d, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_turn_repair")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return repair.digests(source(spark, d, "conversations"))


OP12_SQL = r"""
with words as (
  select row_number() over () as k, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents where text is not null),
docs as (select k, doc_id, len(ts) as n, ts from words where len(ts) > 0),
corpus as (select count(*) as nn, cast(sum(n) as bigint) as ll from docs),
items as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
tf as (select k, term, count(*) as tf from (select k, unnest(ts) as term from docs) where term in (select term from items) group by k, term),
weight as (select term, cast(floor(1000 * ln((2 * nn + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, corpus group by term, nn),
score as (
  select item_id, k, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) as bigint) as score
  from tf join docs using (k) join weight using (term) join items using (term), corpus group by item_id, k),
best as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score
  from score join docs using (k) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from best where rank <= 50"""


@query("op12_automaton_search", OP12_SQL)
def op12(spark: SparkSession, d: str) -> DataFrame:
    return lexical.ranked_search(source(spark, d, "documents"), source(spark, d, "benchmark"))


@query("op13_quality_trees")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(source(spark, d, "documents"), source(spark, d, "labels")).select("doc_id", *quality.BASE, "base_failed", "kept", "score")
