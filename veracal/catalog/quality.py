"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as t
from ..functions.vectors import zero_nonfinite
from ..operators import quality as q
from ..operators.joins import funnel
from .curation import BLANKS, LABELLED, blanks, labelled, strip_sql
from .registry import cte, query, rd, rounded


@query(
    "q01_blank_counts",
    cte(" union all ".join(f"select '{x}' as field, sum(case when {x} is null or {strip_sql(x)} = '' then 1 else 0 end)::bigint as n_blank from B"
                           for x in ("lang", "source", "text", "note")), B=BLANKS),
)
def q01(spark, d):
    return q.blank_counts(blanks(spark, d), ["lang", "source", "text", "note"])


@query("q02_key_uniqueness", cte("select split, count(*) as total, count(distinct hash_id) as n_unique, count(*) - count(distinct hash_id) as duplicates from I group by split", I=fx.ITEMS_SQL))
def q02(spark, d):
    return q.uniqueness(fx.items(spark, d), "hash_id", ["split"])


@query(
    "q03_name_sets",
    cte("""select split, count(*) as n_names, string_agg(dataset, ',' order by dataset) as names, case when split = 'test' then count(*) >= 7 else count(*) = 1 end as ok
from (select distinct split, dataset from I) group by split""", I=fx.ITEMS_SQL),
)
def q03(spark, d):
    rule = F.when(F.col("split") == "test", F.col("n_names") >= 7).otherwise(F.col("n_names") == 1)
    return q.name_sets(fx.items(spark, d), "dataset", ["split"], {"ok": rule})


JOINED = """select I.hash_id, I.split, I.dataset, I.row_idx, concat('v', m.i) as model_name, cast((I.row_idx + m.i) % 3 = 0 as int) as is_correct
from I cross join (select unnest(range(3)) as i) m"""


def joined(spark, d):
    return (
        fx.items(spark, d)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .select("hash_id", "split", "dataset", "row_idx", F.concat(F.lit("v"), "i").alias("model_name"),
                ((F.col("row_idx") + F.col("i")) % 3 == 0).cast("int").alias("is_correct"))
    )


# the contract is the table's own counts with one more row expected per training cell
_CONTRACT_SQL = """select level, split, model, source, actual, actual + case when split = 'train' then 1 else 0 end as expected, split <> 'train' as ok from (
  select 'n_rows' as level, split, '' as model, '' as source, count(*) as actual from J group by split union all
  select 'unique_hash_ids', split, '', '', count(distinct hash_id) from J group by split union all
  select 'model_rows', split, model_name, '', count(*) from J group by split, model_name union all
  select 'model_correct', split, model_name, '', sum(is_correct)::bigint from J group by split, model_name union all
  select 'source_unique', split, '', dataset, count(*) from (select split, hash_id, arg_min(dataset, row_idx) as dataset from J group by split, hash_id) group by split, dataset union all
  select 'model_source_rows', split, model_name, dataset, count(*) from J group by split, model_name, dataset)"""


@query("q04_contract_check", cte(_CONTRACT_SQL, I=fx.ITEMS_SQL, J=JOINED))
def q04(spark, d):
    table = joined(spark, d)
    expected = q.actual_counts(table, order=["row_idx"]).select(
        "level", "split", "model", "source",
        (F.col("actual") + F.when(F.col("split") == "train", 1).otherwise(0)).alias("expected"),
    )
    return q.contract_check(table, expected, order=["row_idx"])


def words(spark, d):
    return fx.items(spark, d).select("split", "row_idx", t.word_count(F.col("question")).alias("words"))


WORDS = f"select split, row_idx, len(list_filter(regexp_split_to_array(question, '{t.WS}+'), lambda x: x <> '')) as words from I"


@query(
    "q05_word_summary",
    cte(f"""select split, {rd('avg(words)')} as mean, {rd('stddev_pop(words)')} as std, min(words)::int as "min", max(words)::int as "max",
  {rd('quantile_cont(words, 0.25)')} as p25, {rd('quantile_cont(words, 0.5)')} as median, {rd('quantile_cont(words, 0.75)')} as p75 from W group by split""", I=fx.ITEMS_SQL, W=WORDS),
)
def q05(spark, d):
    return rounded(q.summary(words(spark, d), "words", ["split"]))


@query(
    "q06_histogram",
    cte(f"""select bin, {rd('lo + bin * (hi - lo) / 50')} as low_edge, n, lo + bin * ((hi - lo) / 50) <= 1.1 * (select quantile_cont(words, 0.95) from W) as shown
from (select cast(least(floor((words - lo) / ((hi - lo) / 50)), 49) as int) as bin, count(*) as n, any_value(lo) as lo, any_value(hi) as hi
  from W, (select min(words)::double as lo, max(words)::double as hi from W) group by 1)""", I=fx.ITEMS_SQL, W=WORDS),
)
def q06(spark, d):
    return rounded(q.histogram(words(spark, d), "words", 50))


@query(
    "q07_clipped_histogram",
    cte("""select dataset, bin, count(*) as n from (select dataset, tokens, cast(least(floor(tokens / (hi / 49)), 48) as int) as bin
  from (select dataset, (width * height) // 196 as tokens from Z), (select quantile_cont((width * height) // 196, 0.99) as hi from Z) where tokens <= hi)
group by dataset, bin""", Z=fx.SIZES_SQL),
)
def q07(spark, d):
    sized = fx.sizes(spark, d).select("dataset", F.expr("width * height div 196").alias("tokens"))
    return q.clipped_histogram(sized, "tokens", ["dataset"])


RUN_ROWS = "select doc_id as idx, case when doc_id % 6 = 0 then null else lang end as lang from documents"


@query(
    "q08_runs",
    cte("""select value, start, "end", "end" - start + 1 as n from (
  select value, start, coalesce(lead(start) over (order by start) - 1, (select max(idx) from R)) as "end" from (
    select lang as value, idx as start, lag(lang) over (order by idx) as before from R where lang is not null)
  where before is null or before <> value)""", R=RUN_ROWS),
)
def q08(spark, d):
    rows = fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("lang")
    )
    return q.runs(rows, "lang", "idx")


_PROFILE = ", ".join(
    f"{rd(f'avg({x})')} as {x}_mean, min({x}) as {x}_min, max({x}) as {x}_max" for x in ("width", "height", "pixels", "tokens")
)
PIXELS = "select *, width * height as pixels, (width * height) // 196 as tokens from Z"


@query("q09_size_profile", cte(f"select dataset, count(*) as n, {_PROFILE}, sum(case when pixels > 16777216 then 1 else 0 end)::bigint as n_large from X group by dataset", Z=fx.SIZES_SQL, X=PIXELS))
def q09(spark, d):
    return rounded(q.size_profile(fx.sizes(spark, d), ["dataset"]))


@query(
    "q10_size_alerts",
    cte(f"""select dataset, count(*) as n, {rd('avg(pixels) / 1e6')} as mean_mp, {rd('max(pixels) / 1e6')} as max_mp, {rd('min(pixels) / 1e6')} as min_mp,
  {rd('avg(tokens)')} as mean_tokens, max(tokens) as max_tokens, max(pixels) / 1e6 > 10 as alert from X group by dataset""", Z=fx.SIZES_SQL, X=PIXELS),
)
def q10(spark, d):
    return rounded(q.size_alerts(fx.sizes(spark, d), ["dataset"]))


@query("q11_label_completeness", cte("select lang, count(*) as total, count(quality) as labelled, count(*) - count(quality) as unlabelled from D group by lang", D=LABELLED))
def q11(spark, d):
    return q.label_completeness(labelled(spark, d), "quality", ["lang"])


@query("q11_unlabelled_rows", cte("select doc_id from D where quality is null", D=LABELLED))
def q11_rows(spark, d):
    return q.unlabelled(labelled(spark, d), "doc_id", "quality")


# every document's lines as its list of paraphrases
def line_lists(spark, d):
    return fx.table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 != 0, F.split("text", "\n")).alias("paraphrases")
    )


@query(
    "q12_paraphrase_completeness",
    """select case when doc_id % 4 = 0 then 'invalid' when len(string_split(text, chr(10))) < 4 then 'incomplete' else 'valid' end as status, count(*) as n from documents group by 1""",
)
def q12(spark, d):
    return q.paraphrase_completeness(line_lists(spark, d), 4)


@query(
    "q13_processing_funnel",
    """select case when toxic = 1 then 'done' when lang = 'de' then 'no_sample' when quality is null then 'no_label'
  when n_chars < 400 then 'no_paraphrase' else 'ok' end as status, count(*) as n from documents left join labels using (doc_id) group by 1""",
)
def q13(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(fx.table(spark, d, "labels"), "doc_id", "left")
    return funnel(rows, {
        "done": F.col("toxic") == 1, "no_sample": F.col("lang") == "de",
        "no_label": F.col("quality").isNull(), "no_paraphrase": F.col("n_chars") < 400,
    })


@query(
    "q14_view_sanity",
    cte(f"""select y, count(*) as n, {rd('avg(mask)')} as mask_rate, {rd('avg(c)')} as cos_mean, {rd('stddev_pop(c)')} as cos_std,
  {rd('min(c)')} as cos_min, {rd('max(c)')} as cos_max, '64' as base_sizes, '64' as view_sizes, avg(mask) < 0.99 as flag
from (select y, mask, case when mask = 1 then list_inner_product(h_base, h_blank) / (sqrt(list_inner_product(h_base, h_base)) * sqrt(list_inner_product(h_blank, h_blank)) + 1e-12) end as c from V) group by y""", V=fx.VIEWS_SQL),
)
def q14(spark, d):
    from ..functions.vectors import view_cosine

    cos = F.when(F.col("mask") == 1, view_cosine(F.col("h_base"), F.col("h_blank"))).otherwise(F.lit(float("nan")))
    return rounded(q.view_sanity(fx.views(spark, d).withColumn("cos", cos), ["y"], "cos", "mask", "h_base", "h_blank"))


# vectors with NaN where a component is above 0.3 and infinity where it is below -0.3
BROKEN = """select vec_id, list_transform(cast(embedding as double[]), lambda x: case when x > 0.3 then cast('nan' as double) when x < -0.3 then cast('-inf' as double) else x end) as v from embeddings"""


def broken(spark, d):
    v = F.col("embedding").cast("array<double>")
    bad = F.transform(v, lambda x: F.when(x > 0.3, F.lit(float("nan"))).when(x < -0.3, F.lit(float("-inf"))).otherwise(x))
    return fx.table(spark, d, "embeddings").select("vec_id", bad.alias("v"))


@query(
    "q15_nonfinite_census",
    cte("""select sum(nan)::bigint as n_nan, sum(inf)::bigint as n_inf, sum(case when nan + inf > 0 then 1 else 0 end)::bigint as n_rows from (
  select len(list_filter(v, lambda x: isnan(x))) as nan, len(list_filter(v, lambda x: isinf(x))) as inf from B)""", B=BROKEN),
)
def q15(spark, d):
    return q.nonfinite(broken(spark, d), "v")


@query("q15_zeroed_vectors", cte(f"select vec_id, {rd('list_sum(list_transform(v, lambda x: case when isfinite(x) then x else 0.0 end))')} as s from B", B=BROKEN))
def q15_zero(spark, d):
    from ..functions.vectors import total

    return rounded(broken(spark, d).select("vec_id", total(zero_nonfinite(F.col("v"))).alias("s")))


@query("q17_image_presence", cte("select lang, count(*) as n_rows, count(note) as n_images, count(*) = count(note) as ok from B group by lang", B=BLANKS))
def q17(spark, d):
    return q.image_presence(blanks(spark, d), ["lang"], "note")
