"""Text parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as t
from ..operators import quality as q
from ..operators.confidence import two_stage_confidence
from .registry import cte, query, rd, rounded

NUM = r"\d+(?:\.\d+)?"
UNIT = "case when {x} is not null then least(greatest(case when {x} > 1 then {x} / 100.0 else {x} end, 0.0), 1.0) end"

VERBAL = f"""select sample_id, {UNIT.format(x='x')} as c from (select sample_id, coalesce(
  try_cast(nullif(regexp_extract(reply, '[Cc]onfidence:\\s*({NUM})\\s*%?', 1), '') as double),
  try_cast(list_last(regexp_extract_all(reply, '({NUM})\\s*%', 1)) as double),
  list_last(list_filter(list_transform(regexp_extract_all(right(reply, 200), '{NUM}'), lambda s: try_cast(s as double)), lambda n: n >= 0 and n <= 100))) as x from R)"""


@query("x01_verbal_confidence", cte(f"select sample_id, {rd('c')} as confidence from ({VERBAL})", R=fx.REPLIES_SQL))
def x01(spark, d):
    return rounded(fx.replies(spark, d).select("sample_id", t.verbal_confidence(F.col("reply")).alias("confidence")))


@query(
    "x01_verbal_confidence_long_texts",
    cte(f"select sample_id, {rd('c')} as confidence from ({VERBAL})",
        R="select doc_id as sample_id, concat(text, ' ', doc_id % 130, case when doc_id % 3 = 0 then '%' else '' end, ' ', lang) as reply from documents"),
)
def x01_long(spark, d):
    i = F.col("doc_id")
    reply = F.concat("text", F.lit(" "), i % 130, F.when(i % 3 == 0, "%").otherwise(""), F.lit(" "), "lang")
    docs = fx.table(spark, d, "documents")
    return rounded(docs.select(i.alias("sample_id"), t.verbal_confidence(reply).alias("confidence")))


FIRST = UNIT.format(x=f"try_cast(nullif(regexp_extract(props, '{NUM}'), '') as double)")


@query("x02_first_number", f"select event_id, {rd(FIRST)} as confidence from events")
def x02(spark, d):
    return rounded(fx.table(spark, d, "events").select("event_id", t.first_number(F.col("props")).alias("confidence")))


JUDGED = "select event_id as sample_id, case when event_type = 'click' then 'cannot say' else concat('about ', props) end as judge_text from events where event_type <> 'error'"
SECOND = UNIT.format(x=f"try_cast(nullif(regexp_extract(judge_text, '{NUM}'), '') as double)")


@query(
    "x03_two_stage_confidence",
    cte(f"""select sample_id, {rd('coalesce(a.c, b.c)')} as confidence, case when a.c is not null then 'stated' when b.c is not null then 'judged' else 'failed' end as status
from ({VERBAL}) a left join (select sample_id, {SECOND} as c from J) b using (sample_id)""", R=fx.REPLIES_SQL, J=JUDGED),
)
def x03(spark, d):
    judged = fx.table(spark, d, "events").where("event_type <> 'error'").select(
        F.col("event_id").alias("sample_id"),
        F.when(F.col("event_type") == "click", "cannot say").otherwise(F.concat(F.lit("about "), "props")).alias("judge_text"),
    )
    return rounded(two_stage_confidence(fx.replies(spark, d), judged))


@query(
    "x04_yes_no_judge",
    cte("""select conv_id, turn, contains(lower(r), 'yes') and not contains(lower(r), 'no') as verdict from (
  select conv_id, turn, case turn % 3 when 0 then concat(response, ' YES') when 1 then concat(' no', chr(10)) else null end as r from X)""", X=fx.OUTPUTS_SQL),
)
def x04(spark, d):
    i = F.col("turn") % 3
    reply = F.when(i == 0, F.concat("response", F.lit(" YES"))).when(i == 1, F.lit(" no\n"))
    return fx.outputs(spark, d).select("conv_id", "turn", t.judge_yes_no(reply).alias("verdict"))


# replies in each of the three layouts, and one without any question
LAYOUTS = """select p_partkey, case p_partkey % 4 when 3 then [] else [concat(p_name, '?'), concat(p_type, ' of ', p_brand, '?')] end as questions from part"""


def layouts(spark, d):
    i = F.col("p_partkey") % 4
    other = F.concat("p_type", F.lit(" of "), "p_brand")
    reply = (
        F.when(i == 0, F.concat(F.lit("[question_1] "), "p_name", F.lit("?\n[/question_1] and [QUESTION_2]"), other, F.lit("?[/question_2]")))
        .when(i == 1, F.concat(F.lit("[question_1] "), "p_name", F.lit(" [question_2] "), other, F.lit("??")))
        .when(i == 2, F.concat(F.lit("1. "), "p_name", F.lit("?\n 2) "), other, F.lit("?\nend")))
        .otherwise(F.concat(F.lit("no list for "), "p_name"))
    )
    return fx.table(spark, d, "part").select("p_partkey", t.paraphrases(reply, 3).alias("paraphrases"))


@query("x05_paraphrases", cte("select p_partkey, cast(len(questions) as int) as n, array_to_string(questions, '|') as questions from L", L=LAYOUTS))
def x05(spark, d):
    p = F.col("paraphrases")
    return layouts(spark, d).select("p_partkey", F.size(p).alias("n"), F.array_join(p, "|").alias("questions"))


@query(
    "x06_paraphrase_status",
    """select case when doc_id % 4 = 0 then 'missing' when len(string_split(text, chr(10))) = 3 then 'created' else 'incorrect_count' end as status, count(*) as n from documents group by 1""",
)
def x06(spark, d):
    from .quality import line_lists

    return q.paraphrase_status(line_lists(spark, d), 3)


@query("x07_word_count", f"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '{t.WS}+'), lambda x: x <> '')) as int) as words from documents")
def x07(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", t.word_count(F.col("text")).alias("words"))
