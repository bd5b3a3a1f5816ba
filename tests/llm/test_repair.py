"""Conversation repair against an exhaustive search, on kinds and on whole tables."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veracal.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def least(kinds):
    """(cost, audit) by trying all edits, at most three insertions in a row."""

    @functools.lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(kinds) and state in "0a" else []
        turn = "a" if state == "u" else "u"
        if inserted < 3:
            cost, audit = best(i, turn, inserted + 1)
            found.append((cost + 5, "I" + audit))
        if i < len(kinds):
            kind = kinds[i]
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit))
            if kind != "x":
                late = 5 * kind.isupper()
                cost, audit = best(i + 1, turn, 0)
                found.append((cost + 1 + late, "R" + audit))
                to = turn if kind.lower() == turn else "s" if kind.lower() == "s" and state == "0" else None
                if to:
                    cost, audit = best(i + 1, to, 0)
                    found.append((cost + late, "K" + audit))
        return min(found, default=(1 << 40, ""))

    return best(0, "0", 0)


def audit_of(code):
    return code.translate(str.maketrans("uaUA", "IIRR"))


def test_search_equals_exhaustive_search():
    draw = random.Random(1)
    for k in range(1500):
        kinds = "".join(draw.choice(repair.KINDS if k % 2 else "uauauaxsUA") for _ in range(draw.randint(0, 8)))
        path = repair.whole_paths(kinds)[0]
        assert (path["cost"], audit_of(path["code"])) == least(kinds), kinds
        if len(kinds) > 2:
            cuts = sorted(draw.sample(range(1, len(kinds)), draw.randint(1, 2)))
            parts = [repair.part_paths(kinds[a:b]) for a, b in zip([0, *cuts], [*cuts, len(kinds)])]
            ways, tail_cost, tail = repair.through_parts(parts)
            taken = [next(p for p in of if (p["enter"], p["leave"]) == way) for of, way in zip(parts, ways)]
            assert (sum(p["cost"] for p in taken) + tail_cost, audit_of("".join(p["code"] for p in taken) + tail)) == least(kinds), kinds


def test_bounds_never_exceed_the_cost():
    draw = random.Random(2)
    for _ in range(300):
        kinds = "".join(draw.choice(repair.KINDS) for _ in range(draw.randint(1, 7)))
        assert repair._bounds(kinds)[0] <= least(kinds)[0]


def repaired(rows):
    """digests() of plain rows, with the exhaustive search."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        case = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        of = by.setdefault(conv, [])
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            of += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, of in by.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in of if r[0] is not None]
        seen, kinds, count = set(), "", {"x": 0, "d": 0, "t": 0}
        for _, role, text in of:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "x" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] = count.get(fault, 0) + 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("x", "d") else kind.upper() if fault else kind
        cost, audit = least(kinds)
        lines, state, left = [], "0", iter(of)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit != "D":
                turn = "a" if state == "u" else "u"
                name = row[1] if edit == "K" else "user" if turn == "u" else "assistant"
                state = "s" if edit == "K" and row[1][:1] == "s" else turn
                lines.append(f"{name}:{row[2] if row else ''}")
        initials = [r[1][:1] for r in of]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["x"], count["d"], count["t"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def hard_rows():
    draw = random.Random(3)
    texts = ["Yes.", "No!", "Why?\n", "cut off", "", " \t", None, "Ende… ", "é. ", "Same. "]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "usr"]
    rows = [(c, t, roles[t % 2] if draw.random() < 0.7 else draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {c} {t}.") for c in range(60) for t in range(draw.randint(1, 9))]
    rows += [(100, None, "user", "a."), (100, None, "assistant", "b."), (100, 5, "user", "c."), (100, 5, "user", "d."), (100, 5, "user", "c."), (101, None, "user", None)]
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, 2, "assistant", "y."), (102, 10**12, "user", "z" * 200_000 + "."), (102, 4, "system", "w.")]
    return rows


@pytest.mark.parametrize("block_rows", [3, 128])
def test_conversations_equal_exhaustive_search(spark, block_rows):
    rows = hard_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("x")).withColumn("_tie", F.lit("y")).withColumn("code", F.lit("z")).withColumn("_case", F.lit(7))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(df, block_rows).collect()}
    assert got == repaired(rows)


def test_one_long_conversation(spark):
    draw = random.Random(4)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(600)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    rows = [(c, t, draw.choice(["user", "assistant"]) if draw.random() < 0.1 else r, x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(df, 50).collect()}
    whole = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(df, 10_000).collect()}
    assert parts == whole and len(parts[1][6]) >= 500


def test_no_rows_after_damage_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)
    assert [tuple(r) for r in repair.digests(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.digests(df.where("false")).collect() == []


def test_real_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(df).collect()}
    assert got == repaired([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
