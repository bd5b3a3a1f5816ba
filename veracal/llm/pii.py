"""Replacing personal data by keyed surrogates of the same kind.

Entities are found by pattern, reduced to a canonical value, and looked up in one
table of surrogates for the whole corpus, so an entity has the same surrogate
wherever and however it is written. Surrogates are drawn from a keyed hash. A
check over the table finds draws that two entities share, or that are themselves
an entity of the corpus; the loser draws again until none is left.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import free_names, stored

KEY = "change-me"  # parameter: whoever holds it can redraw the surrogates

# Titles and given names that mark a person, by gender, and the names surrogates are made of, by script.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sir", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"],
    "n": ["Dr", "Prof", "Mx"],
}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "Thomas", "Peter", "Hans", "Pierre", "Carlos", "Jorge", "Lukas", "Henri"],
    ("f", "latin"): ["Mary", "Anna", "Linda", "Susan", "Sarah", "Julia", "Greta", "Claire", "Lucia", "Elena", "Ingrid", "Sofia"],
    ("n", "latin"): ["Alex", "Robin", "Kim", "Sascha", "Noa", "Charlie"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"],
    ("f", "cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя"],
}
FAMILY = {
    "latin": ["Smith", "Brown", "Taylor", "Wilson", "Keller", "Vogel", "Martin", "Bernard", "Lopez", "Navarro", "Lind", "Moreau"],
    "cyrillic": ["Иванов", "Петров", "Соколов", "Лебедев", "Козлов", "Новиков"],
}

_TITLE = {t: g for g, words in TITLES.items() for t in words}
_NAME = {n: (g, script) for (g, script), words in GIVEN.items() for n in words}
_WORD = r"[^\W\d_][^\W\d_'’-]*"
_LETTER, _UPPER = r"[^\W\d_]", "[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and (c.isupper() or c.istitle())) + "]"
# to the word's end: inner capitals, marks, apostrophes and hyphens before a letter, but no genitive
_CAP = rf"(?:{_UPPER}(?:{_LETTER}|[̀-ͯ]|['’](?!s\b)(?={_LETTER})|-(?={_LETTER}))+)"
_PARTICLE = "(?:von|vom|zu|van|der|den|de|del|della|di|da|do|dos|du|la|le|bin|al|el|ten|ter) "
_FULL = rf"(?:{_UPPER}\. ?|{_CAP} ){{0,3}}(?:{_PARTICLE}){{0,3}}{_CAP}"
_PART = re.compile(rf"{_UPPER}\.|{_CAP}")
PATTERNS = [
    ("email", r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("secret", r"\b(?:[0-9a-fA-F]{32,}|(?:AKIA|ghp_|sk-)[A-Za-z0-9_-]{16,})\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{1,4}|(?<=::))(?!\w|:[0-9A-Fa-f])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|\+\d(?:[ .()/-]{0,2}\d){7,14}|0\d(?:[ .-]\d{2}){4})(?![\w]|[.-]\d)"),
    ("person", rf"\b(?P<title>{'|'.join(_TITLE)})(?P<dot>\.?) (?:(?:{'|'.join(_TITLE)})\.? )*(?P<full>{_FULL})|\b(?P<given>{'|'.join(_NAME)}) (?P<rest>{_FULL})"),
]
FINDER = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
# what every match holds: a digit, an at sign, two colons, a key's head, or a name; other texts pass untouched, without
# leaving the JVM, whose classes are those of ``re``. The look-ahead spares most words the long list of names.
HINT = (
    rf"[\p{{Nd}}@]|:[0-9A-Fa-f]{{0,4}}:|ghp_|sk-|[a-fA-F]{{32}}"
    rf"|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}_])(?:AKIA|{'|'.join([*_TITLE, *_NAME])})"
)

ENTITY = StructType([StructField("kind", StringType()), StructField("value", StringType())])
MAPPED = StructType([*ENTITY.fields, StructField("surrogate", StringType())])


def _script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "latin"


def _names(match: re.Match) -> list[tuple[str, str, int, int]]:
    """The parts of a person's name: (kind, value, start, end); kind holds gender and script."""
    out = []
    gender = _TITLE.get(match["title"])
    parts = [(m[0], m.start(), m.end()) for m in _PART.finditer(match.string, *match.span("full" if match["full"] else "rest"))]
    if match["given"]:
        gender = _NAME[match["given"]][0]
        parts.insert(0, (match["given"], *match.span("given")))
    elif len(parts) > 1:
        gender = _NAME.get(parts[0][0], (gender,))[0]
    for word, start, end in parts[:-1]:
        out.append((f"given-{gender}-{_script(word)}", word.casefold(), start, end))
    word, start, end = parts[-1]
    out.append((f"family-{_script(word)}", word.casefold(), start, end))
    return out


def _again(text: str, found: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """The names of ``found`` where they stand elsewhere in the text, without title or given name."""
    known: dict[str, tuple[str, str]] = {}
    for kind, value, start, end in found:
        if kind.startswith(("given-", "family-")) and not value.endswith("."):
            for form in (text[start:end], text[start:end].upper()):
                known.setdefault(form, (kind, value))
    if not known:
        return found
    words = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)")
    out, at = [], 0
    for one in [*found, ("", "", len(text), len(text))]:
        out += [(*known[m[0]], *m.span()) for m in words.finditer(text, at, one[2])]
        out.append(one)
        at = one[3]
    return out[:-1]


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical value, start, end) of each entity, in order."""
    out, at = [], 0
    while match := FINDER.search(text, at):
        at = match.end()
        kind = match.lastgroup if match.lastgroup in dict(PATTERNS) else "person"
        if kind == "person":
            out += _names(match)
            continue
        value = match[0]
        if kind in ("card", "ssn"):
            canon = re.sub(r"\D", "", value)
        elif kind == "phone":
            canon = ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
        elif kind == "ip":
            canon = ".".join(str(int(x)) for x in value.split("."))
        elif kind == "ip6":
            try:
                canon = ipaddress.IPv6Address(value).compressed
            except ValueError:  # a time, a hardware address
                at = match.start() + 1
                continue
        elif kind == "iban":
            canon = value.replace(" ", "")
        else:
            canon = value.lower() if kind == "email" else value
        out.append((kind, canon, *match.span()))
    return _again(text, out)


class _Draw:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: str, *what):
        self.left, self.seed, self.count = 0, hashlib.blake2b("\0".join(map(str, what)).encode("utf-8", "surrogatepass"), key=key.encode()[:64]).digest(), 0

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.count += 1
            self.left = self.left << 256 | int.from_bytes(hashlib.blake2b(self.seed + self.count.to_bytes(4, "big"), digest_size=32).digest(), "big")
        self.left, found = divmod(self.left, n)
        return found

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case, all else as it is."""
        sets = [("0123456789", str.isdigit), ("abcdefghijklmnopqrstuvwxyz", str.islower), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", str.isupper)]
        return "".join(next((s[self.below(len(s))] for s, test in sets if test(c)), c) for c in text)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


#: Draws that keep an entity's exact length; later ones add to it, so that no kind runs out of surrogates.
SAME_LENGTH = 16


def surrogate(kind: str, value: str, key: str = KEY, attempt: int = 0) -> str:
    """The draw of an entity: same kind, length and layout, gender and script.

    Later attempts draw from a larger space: names of more parts, longer
    numbers, IPv6 for addresses, so every kind always has a free surrogate.
    """
    draw = _Draw(key, kind, value, attempt)
    more = max(0, attempt - SAME_LENGTH)
    if more and kind == "ip":
        kind = "ip6"
    if more and kind in ("card", "phone", "ssn", "iban", "secret"):
        return surrogate(kind, value, f"{key}/{attempt}", 0) + "".join(str(draw.below(10)) for _ in range(more))
    if kind == "email":
        local, _, domain = value.partition("@")
        other = _Draw(key, "domain", domain)  # one surrogate for a domain, whoever writes from it
        # short local parts have few forms, so those that lost a draw grow
        return f"{draw.like(local)}{''.join(chr(97 + draw.below(26)) for _ in range(attempt))}@{''.join(chr(97 + other.below(26)) for _ in range(8))}.example"
    if kind == "ip":
        a, b = value.split(".")[:2]
        # an address of a reserved range keeps its range
        if a in ("10", "127"):
            b = str(draw.below(256))
        elif a == "172" and 16 <= int(b) <= 31:
            b = str(16 + draw.below(16))
        elif (a, b) not in (("192", "168"), ("169", "254")):
            a, b = str(11 + draw.below(112)), str(draw.below(256))
        return ".".join([a, b, str(draw.below(256)), str(1 + draw.below(254))])
    if kind == "ip6":
        return "2001:db8:" + ":".join(f"{1 + draw.below(65535):x}" for _ in range(6))
    if kind == "card":
        digits = "".join(str(draw.below(10)) for _ in value)
        if _luhn(value) == 0:
            digits = next(digits[:-1] + d for d in "0123456789" if _luhn(digits[:-1] + d) == 0)
        return digits
    if kind == "phone":
        keep = 2 if value.startswith("+") else 0  # the plus sign and the first digit of the country
        return value[:keep] + draw.like(value[keep:])
    if kind == "iban":
        return value[:2] + draw.like(value[2:])
    if kind == "secret" and not value.startswith(("AKIA", "ghp_", "sk-")):
        low = "".join("0123456789abcdef"[draw.below(16)] for _ in value)
        return low.upper() if value.upper() == value else low
    if kind == "secret":
        head = re.match("AKIA|ghp_|sk-", value)[0]
        return head + draw.like(value[len(head):])
    if kind.startswith("given-"):
        _, gender, script = kind.split("-")
        pool = GIVEN.get((gender, script)) or GIVEN["n", script]
        return "-".join(pool[draw.below(len(pool))] for _ in range(attempt // 2 + 1))
    if kind.startswith("family-"):
        pool = FAMILY[kind.split("-")[1]]
        return "-".join(pool[draw.below(len(pool))] for _ in range(attempt // 2 + 1))
    return draw.like(value)


def written(found: str, kind: str, new: str) -> str:
    """A surrogate in the layout of what it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(new.removeprefix("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in found) + "".join(chars)
    if kind == "email" and found.upper() == found:
        return new.upper()
    return new


@pandas_udf(ArrayType(ENTITY))
def _found(text: pd.Series) -> pd.Series:
    return pd.Series([sorted({e[:2] for e in entities(t)}) if t else [] for t in text], dtype=object)


def surrogate_table(found: DataFrame, key: str = KEY) -> DataFrame:
    """``kind``, ``value``, ``surrogate`` for distinct entities (``kind``, ``value``), all surrogates of a kind distinct.

    Each round draws for the open entities and keeps, for each surrogate, one
    that has it: an entity of an earlier round, else the smallest. A surrogate
    that is an entity of the corpus is never kept. The tables are stored, so the
    draws do not depend on the run.
    """

    @pandas_udf(StringType())
    def drawn(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, key, int(a)) for k, v, a in zip(kind, value, attempt)], dtype=object)

    own = found.select("kind", F.col("value").alias("surrogate"))
    folded = F.when(F.col("kind").rlike("^(given|family)-"), F.lower("surrogate")).otherwise(F.col("surrogate"))
    settled, open_, attempt = None, found, 0
    while True:
        tried = open_.withColumn("surrogate", drawn("kind", "value", F.lit(attempt))).withColumn("new", F.lit(True))
        every = tried if settled is None else tried.unionByName(settled.withColumn("new", F.lit(False)))
        every = every.withColumn("as", folded)
        first = every.groupBy("kind", "as").agg(F.min(F.struct("new", "value")).alias("first"))
        free = first.join(own.withColumnRenamed("surrogate", "as"), ["kind", "as"], "left_anti")
        kept = every.join(free, ["kind", "as"], "left")
        checked = stored(
            kept.select("kind", "value", "surrogate", F.coalesce(F.col("first.value") == F.col("value"), F.lit(False)).alias("ok")), "surrogates"
        )
        settled = checked.where("ok").drop("ok")
        open_ = checked.where(~F.col("ok")).select("kind", "value")
        attempt += 1
        if open_.isEmpty():
            return settled


def replace_entities(df: DataFrame, text: str = "text", length: str | None = None, key: str = KEY) -> DataFrame:
    """The rows with all entities of ``text`` replaced, and ``n_entities``, the number of replacements.

    Rows without a hint of an entity are passed through; only the others meet the
    table, by a digest of their text. ``length`` names a column that holds the
    text's length and is set anew. Null and empty texts stay as they are; rows
    alike stay alike. A column ``n_entities`` of the input is replaced, all others
    stay, whatever their names. An empty table gives no rows.
    """
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    plain = df.where(~hinted).withColumn("n_entities", F.lit(0))
    digest = [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")]
    some = stored(
        df.where(hinted).select(*digest, F.explode(_found(F.col(text))).alias("e")).select("_h1", "_h2", "e.kind", "e.value").distinct(),
        "entities",
    )
    table = surrogate_table(stored(some.select("kind", "value").distinct(), "entities"), key)
    by_text = some.join(table, ["kind", "value"]).groupBy("_h1", "_h2").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("_map"))
    result = StructType([StructField("text", StringType()), StructField("n", IntegerType())])

    @pandas_udf(result)
    def rewritten(text: pd.Series, known: pd.Series) -> pd.DataFrame:
        out = []
        for t, pairs in zip(text, known):
            if t is None or pairs is None:
                out.append((t, 0))
                continue
            of = {(p["kind"], p["value"]): p["surrogate"] for p in pairs}
            parts, at, n = [], 0, 0
            for kind, value, start, end in entities(t):
                parts += [t[at:start], written(t[start:end], kind, of[kind, value])]
                at, n = end, n + 1
            out.append(("".join([*parts, t[at:]]), n))
        return pd.DataFrame(out, columns=["text", "n"])

    h1, h2, pairs, new = free_names(df, "_h1", "_h2", "_map", "_new")
    others = df.where(hinted).withColumns({h1: digest[0], h2: digest[1]})
    joined = others.join(by_text.toDF(h1, h2, pairs), [h1, h2], "left").withColumn(new, rewritten(F.col(text), F.col(pairs)))
    done = joined.withColumn(text, F.col(f"{new}.text")).withColumn("n_entities", F.col(f"{new}.n"))
    if length is not None:
        done = done.withColumn(length, F.length(text).cast(df.schema[length].dataType))
    names = [*[c for c in df.columns if c != "n_entities"], "n_entities"]
    return plain.select(*names).unionByName(done.select(*names))
