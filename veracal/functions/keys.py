"""Content keys, seeds and item-text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Separators and placeholders of the key format.
SEP = "[SEP]"
LIST_SEP = "[LSEP]"
MISSING = "N/A"

# Characters that str.strip() / str.split() treat as white space.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Everything else, in the form that scans fastest.
NOT_WS = r"(?U)[^\s\x1c-\x1f]"

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def has_text(col: Column) -> Column:
    """Whether a text holds anything but white space; stops at the first such character."""
    return F.coalesce(col.rlike(NOT_WS), F.lit(False))


def na(col: Column) -> Column:
    """Null or blank becomes the placeholder; other text is kept unstripped."""
    return F.when(has_text(col), col).otherwise(F.lit(MISSING))


def content_key(*cols: Column) -> Column:
    """md5 of the coerced fields joined by the separator."""
    return F.md5(F.concat_ws(SEP, *[na(c.cast("string")) for c in cols]))


def fallback_key(hash_id: Column, dataset: Column, question: Column, answer: Column) -> Column:
    """The given key, or a sha256 of the raw fields where it is missing."""
    raw = F.concat_ws(SEP, *[F.coalesce(c, F.lit("")) for c in (dataset, question, answer)])
    return F.coalesce(hash_id, F.sha2(raw, 256))


def _digest_head(key: Column, seed: int, salt: str, digits: int) -> Column:
    salted = F.concat(key, F.lit(f"_{salt}")) if salt else key
    head = F.conv(F.substring(F.sha2(salted, 256), 1, digits), 16, 10).cast("bigint")
    return head.bitwiseXOR(F.lit(seed).cast("bigint"))


def row_seed(key: Column, seed: int, salt: str = "") -> Column:
    """Deterministic 32-bit seed of a row, mixed with a global seed."""
    return _digest_head(key, seed, salt, 8)


def row_draw(key: Column, seed: int, salt: str = "") -> Column:
    """Deterministic 60-bit draw of a row: wide enough to pick among all rows of any table."""
    return _digest_head(key, seed, salt, 15)


def other_position(draw: Column, own: Column, n: Column) -> Column:
    """A position below ``n`` other than ``own``, evenly drawn; the only one if there is no other."""
    picked = F.pmod(draw, F.when(n > 1, n - 1).otherwise(F.lit(1)))
    return F.when(n > 1, picked + (picked >= own).cast("bigint")).otherwise(F.lit(0))


def _literal_json(text: Column) -> Column:
    """Rewrite bare Python constants of a printed container to JSON ones."""
    out = text
    for word, token in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, f"(?<=[:,\\[\\{{]\\s?){word}(?=\\s*[,\\]\\}}])", token)
    return out


_LOOSE = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def dict_field(text: Column, key: str) -> Column:
    """One value of a printed dict, null when it does not parse."""
    parsed = F.from_json(_literal_json(text), "map<string,string>", _LOOSE)
    return F.try_element_at(parsed, F.lit(key))


def parse_list(text: Column) -> Column:
    """A printed list as an array of strings, null when it does not parse."""
    looks_like_list = text.rlike(r"^\s*\[")
    return F.when(looks_like_list, F.from_json(_literal_json(text), "array<string>", _LOOSE))


def mc_question(question: Column, options: list[Column]) -> Column:
    """Stripped question plus lettered options; the fifth only when it is given."""
    parts = [strip(question)]
    for letter, opt in zip(LETTERS, options[:4]):
        parts.append(F.concat(F.lit(f"\n{letter}) "), F.coalesce(opt, F.lit("None"))))
    if len(options) > 4:
        last = options[4]
        given = last.isNotNull() & (F.lower(strip(last)) != "none")
        parts.append(F.when(given, F.concat(F.lit("\nE) "), last)).otherwise(F.lit("")))
    return F.concat(*parts)


def mc_question_list(question: Column, options: Column) -> Column:
    """Unstripped question plus every option of an array, lettered from A."""
    lines = F.transform(
        options,
        lambda opt, i: F.concat(F.lit("\n"), F.char(i + F.lit(65)), F.lit(") "), opt),
    )
    return F.when(F.size(options) > 0, F.concat(question, F.array_join(lines, ""))).otherwise(question)


def composite_category(subject: Column, difficulty: Column, types: Column) -> Column:
    """subject, difficulty and the joined type list, each with the placeholder."""
    joined = F.when(F.size(types) > 0, F.array_join(types, LIST_SEP)).otherwise(F.lit(MISSING))
    return F.concat_ws(SEP, na(subject), na(difficulty), joined)


def present_columns(names: list[str]) -> Column:
    """Comma list of the non-null columns, in the given order."""
    listed = F.concat_ws(",", *[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
    return F.when(listed == "", F.lit("no_images")).otherwise(listed)


def first_present(names: list[str]) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


def answer_letter(text: Column, options: list[Column]) -> Column:
    """Letter whose option equals the text, else the first one that contains it or is contained.

    A missing answer is read as ``nan``, as a table reader prints it, so it has no
    letter unless an option happens to hold that word.
    """
    wanted = F.lower(strip(F.coalesce(text, F.lit("nan"))))
    cleaned = []
    for i, opt in enumerate(options):
        t = F.lower(strip(F.coalesce(opt, F.lit(""))))
        cleaned.append(F.when(t == "none", F.lit("")).otherwise(t) if i == 4 else t)
    exact = [F.when((t != "") & (t == wanted), F.lit(LETTERS[i])) for i, t in enumerate(cleaned)]
    loose = [
        F.when((t != "") & (t.contains(wanted) | wanted.contains(t)), F.lit(LETTERS[i]))
        for i, t in enumerate(cleaned)
    ]
    return F.coalesce(*exact, *loose)


def short_name(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def bounded_size(width: Column, height: Column, limit: int = 2048) -> Column:
    """struct(width, height) scaled down so that the longer side fits the limit."""
    longest = F.greatest(width, height)
    scale = F.lit(float(limit)) / longest
    fits = longest <= limit
    return F.struct(
        F.when(fits, width).otherwise(F.floor(width * scale)).cast("int").alias("width"),
        F.when(fits, height).otherwise(F.floor(height * scale)).cast("int").alias("height"),
    )


def data_url(content: Column) -> Column:
    # base64 breaks lines at 76 characters; the URL form has none
    return F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64(content), "\r\n", ""))
