"""Curation queries: keys, item texts, unions, deduplication, strata, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import keys as k
from ..functions import text as t
from ..functions import vectors as v
from ..operators import curate as c
from .registry import cte, query, rd, rounded

WS = k.WS


def strip_sql(x):
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+\\z', '')"


def na_sql(x):
    return f"case when {x} is null or {strip_sql(x)} = '' then 'N/A' else {x} end"


# a text column with nulls, blanks and padded values, made from every document
BLANKS = """select doc_id, lang, source, text, case doc_id % 5 when 0 then null when 1 then '' when 2 then concat(chr(9), ' ', chr(160))
  when 3 then concat(' ', lang, chr(10)) else lang end as note from documents"""


def blanks(spark, d):
    i = F.col("doc_id") % 5
    note = (
        F.when(i == 0, F.lit(None)).when(i == 1, "").when(i == 2, "\t  ")
        .when(i == 3, F.concat(F.lit(" "), "lang", F.lit("\n"))).otherwise(F.col("lang"))
    )
    return fx.table(spark, d, "documents").select("doc_id", "lang", "source", "text", note.alias("note"))


@query("c01_na_coercion", cte(f"select doc_id, {na_sql('note')} as note from B", B=BLANKS))
def c01(spark, d):
    return blanks(spark, d).select("doc_id", k.na(F.col("note")).alias("note"))


@query(
    "c02_content_key",
    cte(f"""select doc_id, md5(concat_ws('[SEP]', {na_sql('source')}, {na_sql('note')}, {na_sql('text')}, {na_sql('lang')}, cast(doc_id as varchar))) as hash_id from B""", B=BLANKS),
)
def c02(spark, d):
    cols = [F.col(x) for x in ("source", "note", "text", "lang", "doc_id")]
    return blanks(spark, d).select("doc_id", k.content_key(*cols).alias("hash_id"))


@query(
    "c03_fallback_key",
    cte("""select doc_id, coalesce(case when doc_id % 2 = 0 then md5(text) end,
  sha256(concat_ws('[SEP]', source, text, coalesce(note, '')))) as hash_id from B""", B=BLANKS),
)
def c03(spark, d):
    given = F.when(F.col("doc_id") % 2 == 0, F.md5("text"))
    return blanks(spark, d).select("doc_id", k.fallback_key(given, F.col("source"), F.col("text"), F.col("note")).alias("hash_id"))


@query(
    "c04_row_seed",
    """select doc_id, xor(cast(concat('0x', substr(sha256(cast(doc_id as varchar)), 1, 8)) as bigint), 42) as seed,
  xor(cast(concat('0x', substr(sha256(concat(cast(doc_id as varchar), '_noise')), 1, 8)) as bigint), 42) as salted from documents""",
)
def c04(spark, d):
    key = F.col("doc_id").cast("string")
    return fx.table(spark, d, "documents").select(
        "doc_id", k.row_seed(key, 42).alias("seed"), k.row_seed(key, 42, "noise").alias("salted")
    )


@query(
    "c05_dict_field",
    """select event_id, case event_id % 4 when 0 then null when 3 then null else event_type end as detailed from events""",
)
def c05(spark, d):
    i = F.col("event_id") % 4
    value = F.concat(F.lit("'"), "event_type", F.lit("'"))
    printed = (
        F.when(i == 0, F.lit("{'structural': 'query', 'detailed': None}"))
        .when(i == 1, F.concat(F.lit("{'structural': None, 'flag': True, 'detailed': "), value, F.lit("}")))
        .when(i == 2, F.concat(F.lit('{"detailed": '), value, F.lit(', "semantic": "rel"}')))
        .otherwise(F.lit("not a dict"))
    )
    return fx.table(spark, d, "events").select("event_id", k.dict_field(printed, "detailed").alias("detailed"))


# options made from the words of part names and types
OPTIONS = """select p_partkey, p_name, p_type, p_brand, lower(p_type) as a, split_part(p_name, ' ', 1) as b,
  split_part(p_name, ' ', 2) as c, p_brand as d,
  case p_partkey % 3 when 0 then null when 1 then 'None' else concat(p_name, ' x') end as e,
  case p_partkey % 4 when 0 then concat(' ', split_part(p_name, ' ', 2)) when 1 then p_type when 2 then concat(p_name, ' x y') else 'zzz' end as answer from part"""


def options(spark, d):
    i, j = F.col("p_partkey") % 3, F.col("p_partkey") % 4
    return fx.table(spark, d, "part").select(
        "p_partkey", "p_name", "p_type", "p_brand",
        F.lower("p_type").alias("a"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("b"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("c"),
        F.col("p_brand").alias("d"),
        F.when(i == 0, F.lit(None)).when(i == 1, "None").otherwise(F.concat("p_name", F.lit(" x"))).alias("e"),
        F.when(j == 0, F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2))))
        .when(j == 1, F.col("p_type")).when(j == 2, F.concat("p_name", F.lit(" x y"))).otherwise("zzz").alias("answer"),
    )


@query(
    "c06_choice_question",
    cte("""select p_partkey, concat(p_name, chr(10), 'A) ', a, chr(10), 'B) ', b, chr(10), 'C) ', c, chr(10), 'D) ', d,
  case when e is not null and lower(trim(e)) <> 'none' then concat(chr(10), 'E) ', e) else '' end) as question from O""", O=OPTIONS),
)
def c06(spark, d):
    opts = [F.col(x) for x in "abcde"]
    padded = F.concat(F.lit("\t "), "p_name", F.lit(" \n"))
    return options(spark, d).select("p_partkey", k.mc_question(padded, opts).alias("question"))


@query(
    "c07_choice_question_list",
    """select doc_id, case when lang = 'en' then text else concat(text, array_to_string(list_transform([lang, source, cast(n_chars as varchar)],
  lambda o, i: concat(chr(10), chr(cast(64 + i as int)), ') ', o)), '')) end as question from documents""",
)
def c07(spark, d):
    printed = F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("', '"), F.col("n_chars").cast("string"), F.lit("']"))
    given = F.when(F.col("lang") == "en", F.lit("no list")).otherwise(printed)
    return fx.table(spark, d, "documents").select(
        "doc_id", k.mc_question_list(F.col("text"), k.parse_list(given)).alias("question")
    )


@query(
    "c08_composite_category",
    cte(f"""select doc_id, concat_ws('[SEP]', {na_sql('source')}, {na_sql('note')},
  case when doc_id % 2 = 0 then concat(lang, '[LSEP]', source) else 'N/A' end) as category from B""", B=BLANKS),
)
def c08(spark, d):
    types = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return blanks(spark, d).select("doc_id", k.composite_category(F.col("source"), F.col("note"), types).alias("category"))


@query(
    "c09_present_columns",
    cte("""select doc_id, case when n1 is null and n2 is null and n3 is null then 'no_images' else concat_ws(',',
  case when n1 is not null then 'image_1' end, case when n2 is not null then 'image_2' end, case when n3 is not null then 'image_3' end) end as present,
  coalesce(n1, n2, n3) as first_one from (select doc_id, case when doc_id % 2 = 0 then lang end as n1, case when doc_id % 3 = 0 then source end as n2,
  case when doc_id % 5 = 0 then note end as n3 from B)""", B=BLANKS),
)
def c09(spark, d):
    i = F.col("doc_id")
    names = ["image_1", "image_2", "image_3"]
    shaped = blanks(spark, d).select(
        "doc_id", F.when(i % 2 == 0, F.col("lang")).alias("image_1"), F.when(i % 3 == 0, F.col("source")).alias("image_2"),
        F.when(i % 5 == 0, F.col("note")).alias("image_3"),
    )
    return shaped.select("doc_id", k.present_columns(names).alias("present"), k.first_present(names).alias("first_one"))


def _letters(cond):
    return " ".join(f"when {x} <> '' and ({cond.format(x=x)}) then '{x.upper()}'" for x in "abcde")


@query(
    "c10_answer_letter",
    cte(f"""select p_partkey, letter from (select p_partkey, coalesce(case {_letters('{x} = q')} end,
  case {_letters('contains({x}, q) or contains(q, {x})')} end) as letter from
  (select p_partkey, lower(trim(answer)) as q, lower(a) as a, lower(b) as b, lower(c) as c, lower(d) as d,
   case when e is null or lower(e) = 'none' then '' else lower(e) end as e from O)) where letter is not null""", O=OPTIONS),
)
def c10(spark, d):
    letter = k.answer_letter(F.col("answer"), [F.col(x) for x in "abcde"])
    return options(spark, d).select("p_partkey", letter.alias("letter")).where(F.col("letter").isNotNull())


@query("c11_keep_categories", "select event_id, event_type from events where event_type in ('click', 'view', 'purchase')")
def c11(spark, d):
    return c.keep_categories(fx.table(spark, d, "events"), "event_type", ["click", "view", "purchase"]).select("event_id", "event_type")


@query("c12_short_name", "select page_id, regexp_extract(url, '[^/]*$') as name from pages")
def c12(spark, d):
    return fx.table(spark, d, "pages").select("page_id", k.short_name(F.col("url")).alias("name"))


@query(
    "c13_slice_rows",
    """select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx from orders
qualify idx >= 250 and idx < 1250""",
)
def c13(spark, d):
    return c.slice_rows(fx.table(spark, d, "orders").select("o_orderkey"), 250, 10_000, "o_orderkey", limit=1000)


@query(
    "c14_balanced_shards",
    """with n as (select count(*) as n from orders), o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx from orders),
s as (select i as shard, (n * i) // 7 as lo, (n * (i + 1)) // 7 as hi from n, (select unnest(range(7)) as i))
select o_orderkey, idx, cast(shard as int) as shard from o join s on idx >= lo and idx < hi""",
)
def c14(spark, d):
    return c.balanced_shards(fx.table(spark, d, "orders").select("o_orderkey"), 7, "o_orderkey")


@query(
    "c15_prompts",
    cte("""select conv_id, turn, concat('Question: ', question, chr(10), 'Possible Answer: ', response, chr(10), chr(10),
  'Q: How likely is the above answer to be correct? give your confidence in the following format:', chr(10),
  'Confidence: <number from 0 to 100>%', chr(10), 'Note: The confidence indicates how likely you think the answer is true.') as probe,
  concat('### Original Question: ''', question, '''', chr(10), chr(10), 'Please generate **4** alternative phrasings for this question.', chr(10), chr(10),
  '### Output Format:', chr(10), '[question_1] ... [/question_1]', chr(10), '[question_2] ... [/question_2]', chr(10), '...', chr(10),
  '[question_4] ... [/question_4]') as para from X""", X=fx.OUTPUTS_SQL),
)
def c15(spark, d):
    q, a = F.col("question"), F.col("response")
    return fx.outputs(spark, d).select(
        "conv_id", "turn", t.prompt("self_probing", q, a).alias("probe"), t.prompt("paraphrase", q, n=4).alias("para")
    )


@query(
    "c16_bounded_size",
    cte("""select sample_id, cast(case when m <= 2048 then width else floor(width * (2048.0::double / m)) end as int) as width,
  cast(case when m <= 2048 then height else floor(height * (2048.0::double / m)) end as int) as height
from (select *, greatest(width, height) as m from Z)""", Z=fx.SIZES_SQL),
)
def c16(spark, d):
    s = k.bounded_size(F.col("width"), F.col("height"))
    return fx.sizes(spark, d).select("sample_id", s["width"].alias("width"), s["height"].alias("height"))


@query("c17_data_url", "select doc_id, concat('data:image/png;base64,', base64(encode(text))) as url from documents")
def c17(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", k.data_url(F.encode("text", "UTF-8")).alias("url"))


@query("c18_required_columns", cte("select hash_id, dataset from I", I=fx.ITEMS_SQL))
def c18(spark, d):
    return c.require_columns(fx.items(spark, d), ["hash_id", "dataset", "question"]).select("hash_id", "dataset")


LABELLED = "select doc_id, lang, l.quality from documents left join labels l using (doc_id)"


def labelled(spark, d):
    labels = fx.table(spark, d, "labels").select("doc_id", "quality")
    return fx.table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")


@query("c19_labelled_rows", cte("select doc_id, lang, cast(quality as int) as quality from D where quality is not null", D=LABELLED))
def c19(spark, d):
    return c.labelled(labelled(spark, d), "quality")


@query(
    "u01_ordered_union",
    cte("""select source_name, cast(source_rank as int) as source_rank, split, count(*) as n from (
  select *, 'train' as source_name, 0 as source_rank from I where split = 'train' union all
  select *, 'validation', 1 from I where split = 'validation' union all select *, 'test', 2 from I where split = 'test')
group by all""", I=fx.ITEMS_SQL),
)
def u01(spark, d):
    items = fx.items(spark, d)
    named = {s: items.where(F.col("split") == s) for s in ("train", "validation", "test")}
    return c.ordered_union(named).groupBy("source_name", "source_rank", "split").agg(F.count("*").alias("n"))


@query(
    "u02_split_overlap",
    cte("""select a.s as left_split, b.s as right_split, count(distinct x.hash_id) as n_shared
from (values ('train', 0), ('validation', 1), ('test', 2)) a(s, i) join (values ('train', 0), ('validation', 1), ('test', 2)) b(s, i) on a.i < b.i
left join (select distinct p.hash_id, p.split as ps, q.split as qs from I p join I q on p.hash_id = q.hash_id) x on x.ps = a.s and x.qs = b.s
group by a.s, b.s""", I=fx.ITEMS_SQL),
)
def u02(spark, d):
    out = c.overlap(fx.items(spark, d), "hash_id", "split", ["train", "validation", "test"])
    return out.withColumn("n_shared", F.col("n_shared").cast("bigint"))


@query("u03_key_difference", cte("select hash_id from I where split = 'train' except select hash_id from I where split = 'test'", I=fx.ITEMS_SQL))
def u03(spark, d):
    items = fx.items(spark, d)
    return c.key_difference(items.where("split = 'train'"), items.where("split = 'test'"), "hash_id")


@query(
    "u04_dedup_first",
    cte("""select hash_id, row_idx, dataset, split from (select *, row_number() over (partition by hash_id order by
  case split when 'train' then 0 when 'validation' then 1 else 2 end, row_idx) as k from I) where k = 1""", I=fx.ITEMS_SQL),
)
def u04(spark, d):
    items = fx.items(spark, d).select("hash_id", "row_idx", "dataset", "split")
    named = {s: items.where(F.col("split") == s) for s in ("train", "validation", "test")}
    return c.dedup_first(c.ordered_union(named), "hash_id", ["source_rank", "row_idx"]).select("hash_id", "row_idx", "dataset", "split")


CELLS = "select doc_id, case when doc_id % 9 = 0 then null else concat(lang, '/', source, '/', cast(n_chars // 500 as varchar)) end as cell from documents"


def cells(spark, d):
    name = F.concat_ws("/", "lang", "source", F.expr("n_chars div 500").cast("string"))
    return fx.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, name).alias("cell"))


@query("u05_drop_rare", cte("select doc_id, cell from (select *, count(*) over (partition by cell) as n from C where cell is not null) where n >= 2", C=CELLS))
def u05(spark, d):
    return c.drop_rare(cells(spark, d), "cell", 2)


STRATA = """select doc_id, cell from (
  select *, row_number() over (partition by cell order by md5(concat('42_', cast(doc_id as varchar)))) as k from C join (
    select cell, case when t <= 300 then n else b + case when row_number() over (order by rest desc, cell) <= 300 - sum(b) over () then 1 else 0 end end as quota
    from (select cell, n, t, (300 * n) // t as b, (300 * n) % t as rest from (
      select cell, n, sum(n) over () as t from (select cell, count(*) as n from C where cell is not null group by cell having count(*) >= 2)))) using (cell))
where k <= quota"""


@query("u06_stratified_exact", cte(STRATA, C=CELLS))
def u06(spark, d):
    return c.stratified_exact(cells(spark, d), "cell", "doc_id", 300)


@query("u07_distinct", "select distinct source from documents")
def u07(spark, d):
    return fx.table(spark, d, "documents").select("source").distinct()


@query(
    "u08_top_categories",
    f"""select source, n, {rd('100.0 * n / t')} as pct from (select source, count(*) as n, sum(count(*)) over () as t from documents group by source)
order by n desc, source limit 10""",
)
def u08(spark, d):
    return rounded(c.value_counts(fx.table(spark, d, "documents"), "source", 10))


@query(
    "u09_top_per_group",
    f"""select source, lang, n, cast(rk as int) as rank, {rd('100.0 * n / t')} as pct from (
  select source, lang, n, sum(n) over (partition by source) as t, row_number() over (partition by source order by n desc, lang) as rk
  from (select source, lang, count(*) as n from documents group by source, lang)) where rk <= 2""",
)
def u09(spark, d):
    return rounded(c.value_counts(fx.table(spark, d, "documents"), "lang", 2, ["source"]))


@query(
    "u10_largest_rows",
    cte(f"select sample_id, dataset, width, height, width * height as pixels, (width * height) // 196 as tokens, {rd('width * height / 1e6')} as megapixels from Z order by pixels desc, sample_id limit 20", Z=fx.SIZES_SQL),
)
def u10(spark, d):
    px = F.col("width") * F.col("height")
    sized = fx.sizes(spark, d).withColumns({"pixels": px, "tokens": F.expr("width * height div 196"), "megapixels": px / 1e6})
    return rounded(c.top_rows(sized, [F.desc("pixels"), F.asc("sample_id")], 20))


@query(
    "u11_top_k_logits",
    cte(f"""select sample_id, token_idx, cast(rk as int) as rk, {rd('x')} as value, cast(i as int) as index from (
  select sample_id, token_idx, i, x, row_number() over (partition by sample_id, token_idx order by x desc, i) as rk from (
    select sample_id, token_idx, unnest(logits) as x, unnest(range(len(logits))) as i from T)) where rk <= 5""", T=fx.TOKENS_SQL),
)
def u11(spark, d):
    top = fx.tokens(spark, d).select("sample_id", "token_idx", F.posexplode(v.top_k(F.col("logits"), 5)).alias("p", "s"))
    return rounded(top.select("sample_id", "token_idx", (F.col("p") + 1).alias("rk"), F.col("s.value").alias("value"), F.col("s.index").alias("index")))


@query(
    "u13_best_trial",
    cte("""select epoch, score, min(trial) as trial from H join (select epoch, max(score) as score from H where isfinite(score) group by epoch) using (epoch, score) group by epoch, score""", H=fx.HISTORY_SQL),
)
def u13(spark, d):
    return c.best_trial(fx.history(spark, d), by=["epoch"])
