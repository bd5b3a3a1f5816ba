"""Join and pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import joins as j
from ..operators import pairs as p
from .curation import LABELLED, labelled
from .registry import cte, query, rd, rounded

# outputs: five rows per document, plus one row whose key no document has
OUT = """select hash_id, concat('v', i) as model_name, concat('answer ', row_idx) as model_response, cast((row_idx + i) % 3 = 0 as int) as is_correct
from (select distinct on (hash_id) hash_id, row_idx from I order by hash_id, row_idx) cross join (select unnest(range(5)) as i)
union all select md5(concat('none', event_id)), 'v0', 'x', 0 from events"""


def unique_items(spark, d):
    return fx.items(spark, d).groupBy("hash_id").agg(F.min("row_idx").alias("row_idx"), F.min_by("dataset", "row_idx").alias("dataset"))


def model_outputs(spark, d):
    per_item = unique_items(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "hash_id", F.concat(F.lit("v"), "i").alias("model_name"), F.concat(F.lit("answer "), "row_idx").alias("model_response"),
        ((F.col("row_idx") + F.col("i")) % 3 == 0).cast("int").alias("is_correct"),
    )
    extra = fx.table(spark, d, "events").select(
        F.md5(F.concat(F.lit("none"), "event_id")).alias("hash_id"), F.lit("v0").alias("model_name"),
        F.lit("x").alias("model_response"), F.lit(0).alias("is_correct"),
    )
    return per_item.unionByName(extra)


U = "select distinct on (hash_id) hash_id, row_idx, dataset from I order by hash_id, row_idx"


@query("j01_items_with_outputs", cte("select hash_id, row_idx, dataset, model_name, model_response, is_correct from O join U using (hash_id)", I=fx.ITEMS_SQL, O=OUT, U=U))
def j01(spark, d):
    return j.join_outputs(unique_items(spark, d), model_outputs(spark, d))


@query(
    "j02_join_diagnostics",
    cte("""select side, count(*) as n_keys, min(k) as sample_key from (select coalesce(a.k, b.k) as k, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'common' end as side
  from (select distinct hash_id as k from I where split = 'train' union select 'zzz') a full join (select distinct hash_id as k from O) b on a.k = b.k) group by side""", I=fx.ITEMS_SQL, O=OUT),
)
def j02(spark, d):
    left = fx.items(spark, d).where("split = 'train'").select("hash_id").unionByName(
        spark.range(1).select(F.lit("zzz").alias("hash_id"))
    )
    return j.join_diagnostics(left, model_outputs(spark, d))


@query("j02_missing_keys", cte("select distinct hash_id from O where hash_id not in (select hash_id from I) order by hash_id limit 5", I=fx.ITEMS_SQL, O=OUT))
def j02_keys(spark, d):
    return j.only_in(model_outputs(spark, d), fx.items(spark, d), "hash_id")


# every output whose key is an item's is joined once, though items repeat their keys
@query(
    "j03_row_count_guard",
    cte("select model_name, count(*) as expected, count(*) as actual, true as ok from O where hash_id in (select hash_id from I) group by model_name", I=fx.ITEMS_SQL, O=OUT),
)
def j03(spark, d):
    items, outputs = fx.items(spark, d), model_outputs(spark, d)
    expected = outputs.join(items.select("hash_id"), "hash_id", "left_semi").groupBy("model_name").agg(F.count("*").alias("expected"))
    actual = j.join_outputs(items.drop("model_name"), outputs, order=["row_idx"]).groupBy("model_name").agg(F.count("*").alias("actual"))
    checked = expected.join(actual, "model_name", "full")
    return j.assert_contract(checked.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual"))))


@query(
    "j04_lookup_default",
    cte("""select sample_id, method, vlm, seed, coalesce(p_brand, 'unknown') as dataset from P left join part on p_partkey = sample_id * 7""", P=fx.P_SQL),
)
def j04(spark, d):
    dim = fx.table(spark, d, "part").select((F.col("p_partkey")).alias("key"), F.col("p_brand").alias("dataset"))
    P = fx.predictions(spark, d).select("sample_id", "method", "vlm", "seed", (F.col("sample_id") * 7).alias("key"))
    return j.lookup(P, dim, "key", "dataset", "unknown").drop("key")


@query("j04_lookup_coverage", cte("select count(*) as n_rows, count(p_partkey) as n_matched from P left join part on p_partkey = sample_id * 7", P=fx.P_SQL))
def j04_cov(spark, d):
    dim = fx.table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return j.lookup_coverage(fx.predictions(spark, d).select((F.col("sample_id") * 7).alias("key")), dim, "key")


@query(
    "j05_question_answer",
    "select concat(u.conv_id, ':', u.turn) as question_id, u.text as question, a.text as answer from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'",
)
def j05(spark, d):
    turns = fx.table(spark, d, "conversations")

    def said(role, shift):
        return turns.where(F.col("role") == role).select(F.concat("conv_id", F.lit(":"), F.col("turn") - shift).alias("question_id"), "text")

    return j.question_answers(said("user", 0), said("assistant", 1))


@query("j06_image_lookup", "select l_orderkey, l_linenumber, p_name from lineitem join part on l_partkey * 3 = p_partkey")
def j06(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 3).alias("p_partkey"))
    return j.attach_images(rows, fx.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").drop("p_partkey")


@query(
    "j07_pending_rows",
    "select doc_id, lang from documents where doc_id not in (select doc_id from labels where toxic = 1) and doc_id in (select doc_id from labels where quality is not null)",
)
def j07(spark, d):
    labels = fx.table(spark, d, "labels")
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    return j.pending(docs, labels.where("toxic = 1"), labels, "doc_id", "quality")


OTHER = "select doc_id, case when doc_id % 4 = 0 then null else 1 - quality end as quality from labels where toxic = 0"


def other_labels(spark, d):
    flipped = F.when(F.col("doc_id") % 4 != 0, 1 - F.col("quality"))
    return fx.table(spark, d, "labels").where("toxic = 0").select("doc_id", flipped.alias("quality"))


@query(
    "j08_override_merge",
    cte("""select D.doc_id, case when o.doc_id is not null then o.quality else D.quality end as quality,
  case when o.doc_id is not null then 'merged' when D.quality is not null then 'kept' else 'missing' end as origin from D left join O o on o.doc_id = D.doc_id""", D=LABELLED, O=OTHER),
)
def j08(spark, d):
    return j.override(labelled(spark, d), other_labels(spark, d), "doc_id", "quality").select("doc_id", "quality", "origin")


@query("j09_fallback_merge", cte("select D.doc_id, coalesce(o.quality, D.quality) as quality from D left join O o using (doc_id)", D=LABELLED, O=OTHER))
def j09(spark, d):
    base = fx.table(spark, d, "documents").select("doc_id").join(other_labels(spark, d), "doc_id", "left")
    return j.fallback(base, fx.table(spark, d, "labels"), "doc_id", "quality")


@query(
    "j10_upsert",
    """select concat(o_orderkey, ':', k) as line, coalesce(l_extendedprice, o_totalprice) as price from (select * from orders, (select unnest(range(1, 4)) as k))
left join lineitem on l_orderkey = o_orderkey and l_linenumber = k
union all select concat(l_orderkey, ':', l_linenumber), l_extendedprice from lineitem where l_linenumber > 3 or l_orderkey not in (select o_orderkey from orders)""",
)
def j10(spark, d):
    line = F.explode(F.sequence(F.lit(1), F.lit(3)))
    # three lines for every order, replaced or joined by the lines there are
    old = fx.table(spark, d, "orders").withColumn("k", line).select(F.concat("o_orderkey", F.lit(":"), "k").alias("line"), F.col("o_totalprice").alias("price"))
    new = fx.table(spark, d, "lineitem").select(F.concat("l_orderkey", F.lit(":"), "l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"))
    return j.upsert(old, new, "line")


@query(
    "j11_common_samples",
    cte("""select sample_id, method, vlm, seed from P where (vlm, sample_id) in (select (vlm, sample_id) from P group by vlm, sample_id
  having count(distinct method) = (select count(distinct method) from P))""", P=fx.P_SQL),
)
def j11(spark, d):
    return j.common_samples(fx.predictions(spark, d), ["vlm"], "sample_id").select("sample_id", "method", "vlm", "seed")


def _seed_sql(key: str, salt: str, digits: int = 8) -> str:
    return f"xor(cast(concat('0x', substr(sha256(concat(cast({key} as varchar), '_{salt}')), 1, {digits})) as bigint), 42)"


RING = "select *, row_number() over (order by {key}) - 1 as idx, count(*) over () as n from {table}"


@query(
    "j12_random_partner",
    cte(f"""select a.o_orderkey, b.o_orderkey as other_o_orderkey, b.o_custkey as other_o_custkey from
  (select o_orderkey, s % (n - 1) + case when s % (n - 1) >= idx then 1 else 0 end as pick from (select *, {_seed_sql('o_orderkey', 'partner', 15)} as s from R)) a
join R b on b.idx = a.pick""", R=RING.format(key="o_orderkey", table="orders")),
)
def j12(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return p.random_partner(orders, "o_orderkey", ["o_custkey"]).select("o_orderkey", "other_o_orderkey", "other_o_custkey")


PAIRS = f"""select a.vec_id, a.label, a.embedding, b.vec_id as other_vec_id, b.label as other_label, b.embedding as other_embedding from
  (select *, s % (n - 1) + case when s % (n - 1) >= idx then 1 else 0 end as pick from (select *, {_seed_sql('vec_id', 'pair', 15)} as s from R)) a
join R b on b.idx = a.pick"""


@query("j13_contrast_pairs", cte("select vec_id, other_vec_id, label, other_label, cast(label <> other_label as int) as pair_label from X", R=RING.format(key="vec_id", table="embeddings"), X=PAIRS))
def j13(spark, d):
    emb = fx.table(spark, d, "embeddings")
    return p.contrast_pairs(emb.select("vec_id", "label"), "vec_id", "label", []).select("vec_id", "other_vec_id", "label", "other_label", "pair_label")


BATCH = """select idx // 32 as batch, idx, vec_id, label, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[])))) as e from R"""


@query(
    "j14_batch_similarity",
    cte(f"""select a.batch, a.vec_id, a.label, cast(count(*) filter (b.label = a.label and b.idx <> a.idx) as int) as n_same, cast(count(*) filter (b.label <> a.label) as int) as n_diff,
  {rd('avg(list_inner_product(a.e, b.e)) filter (b.label = a.label and b.idx <> a.idx)')} as same_similarity, {rd('avg(list_inner_product(a.e, b.e)) filter (b.label <> a.label)')} as diff_similarity
from B a join B b using (batch) group by a.batch, a.vec_id, a.label""", R=RING.format(key="vec_id", table="embeddings"), B=BATCH),
)
def j14(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(p.batch_similarity(emb, "vec_id", "label", "embedding"))


@query(
    "l11_pair_loss",
    cte(f"""select {rd('avg(case when label = other_label then dd * dd else pow(greatest(1.0 - dd, 0.0), 2) end)')} as loss, count(*) as n_pairs from (
  select label, other_label, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(cast(embedding[i] as double) - cast(other_embedding[i] as double) + 1e-6, 2)))) as dd from X)""",
        R=RING.format(key="vec_id", table="embeddings"), X=PAIRS),
)
def l11(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return rounded(p.pair_loss(p.contrast_pairs(emb, "vec_id", "label", ["e"]), "e", "other_e"))


@query(
    "l12_contrastive_loss",
    cte(f"""select batch, count(loss) as n_anchors, {rd('coalesce(avg(loss), 0.0)')} as loss from (
  select s.batch, s.vec_id, case when nd > 0 and k is not null then lse - sim end as loss from
    (select batch, vec_id, count(*) filter (lb <> la) as nd, ln(sum(exp(sim)) filter (lb <> la)) as lse from S group by batch, vec_id) s
    left join (select batch, vec_id, sim, k from (select *, row_number() over (partition by batch, vec_id order by idx) - 1 as k, count(*) over (partition by batch, vec_id) as m from S where la = lb)
      where k = {_seed_sql('vec_id', 'positive')} % m) c using (batch, vec_id)
  union all select batch, vec_id, null from B where false)
group by batch""", R=RING.format(key="vec_id", table="embeddings"), B=BATCH,
        S="select a.batch, a.vec_id, a.label as la, b.label as lb, b.idx, list_inner_product(a.e, b.e) / 0.1 as sim from B a join B b on a.batch = b.batch and a.idx <> b.idx"),
)
def l12(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return rounded(p.supcon_loss(emb, "vec_id", "label", "e"))
