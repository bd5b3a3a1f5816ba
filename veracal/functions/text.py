"""Values parsed from model replies, and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import NOT_WS, WS, strip

# Reply patterns and prompt templates.
NUMBER = r"(\d+(?:\.\d+)?)"
STATED = rf"[Cc]onfidence:{WS}*{NUMBER}{WS}*%?"
PERCENT = rf"{NUMBER}{WS}*%"
TAGGED = rf"(?is)\[question_(\d+)\]{WS}*(.*?){WS}*\[/question_\1\]"
UNCLOSED = rf"(?i)\[question_(\d+)\]{WS}*([^\[]+)"
NUMBERED = rf"(?:^|\n){WS}*\d+[\.\)]{WS}*([^\n]+\?)"

SELF_PROBE = (
    "Question: %s\nPossible Answer: %s\n\n"
    "Q: How likely is the above answer to be correct? give your confidence in the following format:\n"
    "Confidence: <number from 0 to 100>%%\n"
    "Note: The confidence indicates how likely you think the answer is true."
)
TRUE_FALSE = (
    "Is the proposed answer correct?\nA) no\nB) yes\nReply with A or B only.\nAnswer: "
)
PARAPHRASE = (
    "### Original Question: '%s'\n\n"
    "Please generate **%s** alternative phrasings for this question.\n\n"
    "### Output Format:\n"
    "[question_1] ... [/question_1]\n[question_2] ... [/question_2]\n...\n"
    "[question_%s] ... [/question_%s]"
)


def prompt(kind: str, question: Column | None = None, answer: Column | None = None, n: int = 10) -> Column:
    if kind == "self_probing":
        return F.format_string(SELF_PROBE, question, answer)
    if kind == "true_false":
        return F.lit(TRUE_FALSE)
    if kind == "paraphrase":
        count = F.lit(str(n))
        return F.format_string(PARAPHRASE, question, count, count, count)
    raise ValueError(f"unknown prompt kind: {kind}")



def _number(text: Column) -> Column:
    """Null instead of an error where the text is no number."""
    return text.try_cast("double")


def _unit(value: Column) -> Column:
    """Percent values above 1 become fractions; 1 itself stays 1."""
    scaled = F.when(value > 1.0, value / 100.0).otherwise(value)
    # least and greatest skip nulls, so a missing number has to be kept apart
    return F.when(value.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def verbal_confidence(reply: Column) -> Column:
    """Stated confidence: labelled value, else last percentage, else last number near the end."""
    stated = _number(F.regexp_extract(reply, STATED, 1))
    percent = _number(F.try_element_at(F.regexp_extract_all(reply, F.lit(PERCENT), 1), F.lit(-1)))
    tail = F.transform(
        F.regexp_extract_all(F.right(reply, F.lit(200)), F.lit(NUMBER), 1),
        lambda x: x.try_cast("double"),
    )
    usable = F.filter(tail, lambda x: (x >= 0.0) & (x <= 100.0))
    trailing = F.try_element_at(usable, F.lit(-1))
    return _unit(F.coalesce(stated, percent, trailing))


def first_number(text: Column) -> Column:
    return _unit(_number(F.regexp_extract(text, NUMBER, 1)))


def judge_yes_no(text: Column) -> Column:
    """True only when the reply has "yes" and not "no"; null text stays null."""
    low = F.lower(text)
    return low.contains("yes") & ~low.contains("no")


def _append_new(base: Column, extra: Column) -> Column:
    return F.aggregate(
        extra,
        base,
        lambda acc, x: F.when(F.array_contains(acc, x), acc).otherwise(F.array_append(acc, x)),
    )


def paraphrases(reply: Column, n: int) -> Column:
    """Up to n questions: closed tags, then open tags, then numbered lines."""
    closed = F.transform(F.regexp_extract_all(reply, F.lit(TAGGED), 2), strip)
    opened = F.transform(
        F.regexp_extract_all(reply, F.lit(UNCLOSED), 2),
        lambda x: F.concat(F.regexp_replace(strip(x), r"\?+\z", ""), F.lit("?")),
    )
    numbered = F.transform(F.regexp_extract_all(reply, F.lit(NUMBERED), 1), strip)
    second = F.when(F.size(closed) < n, _append_new(closed, opened)).otherwise(closed)
    third = F.when(F.size(second) < n, _append_new(second, numbered)).otherwise(second)
    return F.slice(third, 1, n)


def word_count(text: Column) -> Column:
    """Number of words between white space; null counts as no words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{NOT_WS}+")).cast("int")


def percent(value: Column) -> Column:
    """value * 100 with two decimals; a dash for null or NaN."""
    return F.when(value.isNull() | F.isnan(value), F.lit("—")).otherwise(
        F.format_string("%.2f", value * 100)
    )


def stars(p: Column) -> Column:
    """p-value with its significance stars."""
    three = F.format_string("%.3f", p)
    return (
        F.when(p.isNull(), F.lit("—"))
        .when(p < 0.001, F.lit("<0.001***"))
        .when(p < 0.01, F.concat(three, F.lit("**")))
        .when(p < 0.05, F.concat(three, F.lit("*")))
        .otherwise(three)
    )
