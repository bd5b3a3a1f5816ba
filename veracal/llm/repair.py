"""Repair of conversations: the cheapest edits that make turns alternate, found by iterative-deepening A*.

Rows get one position in a total order, and the positions are cut into blocks of equal size, so a conversation of any
length is spread over tasks. Inside a block the search runs over one character a row. A conversation that crosses a block
edge is searched once for each pair of entry and exit state, and the same search then picks one path through its blocks.

Defined cases: a null role or text is one space; rows with a null conversation id form one conversation; null turns come
first, equal turns are ordered by role and text, and repeated rows are kept (the later one is a duplicate). An empty role
or one whose initial is not s, u or a is never kept as it is. An empty table gives no rows. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import ranked, stored

#: Rows of a block; a group in one task holds no more.
BLOCK_ROWS = 128

SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ENDS = (START, ASSISTANT)

# One character a row: x must go; s u a are the initials, o any other; capitals stand for truncated rows.
KINDS = "xsuaoSUAO"
NEVER = 1 << 60



def _rows_of(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(name, kind) for name, kind in fields.items()]))


PATHS = _rows_of(enter=IntegerType(), leave=IntegerType(), cost=LongType(), place=IntegerType(), code=StringType())
WAYS = _rows_of(at=LongType(), cost=LongType(), crossing=LongType(), way=StringType(), tail=StringType())


# --- the search: pure functions over strings of kinds ---


def _edits(kind: str, state: int) -> list[tuple[str, int, int, int]]:
    """(code, cost, rows taken, next state) in ASCII order of the edits' initials.

    Codes tell what an initial leaves open: D and K, u and a for inserted turns, U and A for turns that take that role.
    """
    turn = ASSISTANT if state == USER else USER
    letter = "a" if turn == ASSISTANT else "u"
    out = [("D", DELETE, 1, state)] if kind else []
    out.append((letter, INSERT, 0, turn))
    if kind and kind != "x":
        late = TRUNCATED if kind.isupper() else 0
        initial = kind.lower()
        if initial == letter:
            out.append(("K", late, 1, turn))
        elif initial == "s" and state == START:
            out.append(("K", late, 1, SYSTEM))
        out.append((letter.upper(), REROLE + late, 1, turn))
    return out


@lru_cache(1)
def _windows() -> list[np.ndarray]:
    """Least costs of any one, two and four rows in a row, whatever the states around them."""
    close = np.full((STATES, STATES), NEVER)
    for q in range(STATES):
        close[q, q] = 0
        (_, c1, _, q1), = _edits("", q)
        (_, c2, _, q2), = _edits("", q1)
        close[q, q1] = min(close[q, q1], c1)
        close[q, q2] = min(close[q, q2], c1 + c2)
    one = np.full((len(KINDS), STATES, STATES), NEVER)
    for k, kind in enumerate(KINDS):
        for q in range(STATES):
            for _, cost, rows, to in _edits(kind, q):
                if rows:
                    one[k, q, to] = min(one[k, q, to], cost)

    def then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = (a[:, None, :, :, None] + b[None, :, None, :, :]).min(axis=3)
        return np.minimum(both.reshape(-1, STATES, STATES), NEVER)

    one = then(close[None], one)
    two = then(one, one)
    return [m.min(axis=(1, 2)) for m in (one, two, then(two, two))]


def _bounds(kinds: str) -> list[int]:
    """A lower bound of the cost from each row on: the best way to add up disjoint windows."""
    one, two, four = _windows()
    base = len(KINDS)
    ids = [KINDS.index(k) for k in kinds]
    n = len(ids)
    low = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        best = one[ids[i]] + low[i + 1]
        if i + 2 <= n:
            pair = ids[i] * base + ids[i + 1]
            best = max(best, two[pair] + low[i + 2])
            if i + 4 <= n:
                best = max(best, four[pair * base * base + ids[i + 2] * base + ids[i + 3]] + low[i + 4])
        low[i] = int(best)
    return low


def cheapest(edges: list[list[tuple[str, int, int]]], need: list[int], accept: set[int]) -> tuple[int, list[str]]:
    """Cost and labels of the cheapest path from node 0's entry to an accepted node; of equal ones the first in edge order.

    ``need`` starts as an admissible bound for each node. Depth-first search takes edges in order as long as the bound
    on the whole cost allows; a node that fails is entered in ``need`` with the cost that was proved too small, which
    stops it from being searched again with as little, and sets the next bound. ``need[-1]`` holds the entry node.
    """
    start = need.pop()
    while need[start] < NEVER:
        stack = [[start, need[start], 0, NEVER]]
        labels: list[str] = []
        bound = need[start]
        while stack:
            top = stack[-1]
            node, left, at, _ = top
            if node in accept:
                return bound - left, labels
            out = edges[node]
            if at == len(out):
                stack.pop()
                need[node] = max(need[node], top[3])
                if stack:
                    label, cost, _ = edges[stack[-1][0]][stack[-1][2] - 1]
                    labels.pop()
                    stack[-1][3] = min(stack[-1][3], cost + need[node])
                continue
            top[2] = at + 1
            label, cost, to = out[at]
            if cost + need[to] > left:
                top[3] = min(top[3], cost + need[to])
            else:
                labels.append(label)
                stack.append([to, left - cost, 0, NEVER])
    raise ValueError("no path")


def _graph(kinds: str, ended: bool) -> list[list[tuple[str, int, int]]]:
    edges = []
    for i, kind in enumerate([*kinds, ""]):
        last = i == len(kinds)
        for q in range(STATES):
            found = _edits(kind, q) if not last or ended else []
            edges.append([(code, cost, (i + rows) * STATES + to) for code, cost, rows, to in found])
    return edges


def _audit(code: str) -> str:
    return code.translate(str.maketrans("uaUA", "IIRR"))


@lru_cache(100_000)
def whole_paths(kinds: str) -> list[dict]:
    """The one path of a whole conversation."""
    n = len(kinds)
    need = [b for b in _bounds(kinds) for _ in range(STATES)]
    cost, codes = cheapest(_graph(kinds, True), [*need, START], {n * STATES + q for q in ENDS})
    return [{"enter": START, "leave": -1, "cost": cost, "place": 0, "code": "".join(codes)}]


@lru_cache(10_000)
def part_paths(kinds: str) -> list[dict]:
    """The best path of a part for each pair of entry and exit state; ``place`` orders the paths of one entry state.

    Turns inserted between two parts belong to the later one. Of two audits of one part none is the beginning of the
    other, so the least audit of the whole is made of parts compared one after the other.
    """
    n, low = len(kinds), _bounds(kinds)
    edges = _graph(kinds, False)
    found = []
    for enter in range(STATES):
        of = []
        for leave in range(STATES):
            if leave == START:
                possible, rest = enter == START, [DELETE * (n - i) for i in range(n + 1)]
            elif leave == SYSTEM:
                possible = enter == SYSTEM or enter == START and any(k in "sS" for k in kinds)
                # all but one row go
                rest = [max(0, DELETE * (n - i - 1)) for i in range(n + 1)]
            else:
                possible, rest = True, low
            if possible:
                need = [b for b in rest for _ in range(STATES)]
                cost, codes = cheapest(edges, [*need, enter], {n * STATES + leave})
                of.append({"enter": enter, "leave": leave, "cost": cost, "code": "".join(codes)})
        of.sort(key=lambda p: _audit(p["code"]))
        found += [p | {"place": k} for k, p in enumerate(of)]
    return found


def through_parts(parts: list[list[dict]]) -> tuple[list[tuple[int, int]], int, str]:
    """(entry, exit) state of each part along the cheapest way through all, then cost and code of turns inserted at the end."""
    n = len(parts)
    edges, low = [], [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        low[k] = low[k + 1] + min(p["cost"] for p in parts[k])
    for k, paths in enumerate(parts):
        for q in range(STATES):
            mine = sorted((p for p in paths if p["enter"] == q), key=lambda p: p["place"])
            edges.append([((q, p["leave"]), p["cost"], (k + 1) * STATES + p["leave"]) for p in mine])
    for q in range(STATES):
        edges.append([(code, cost, n * STATES + to) for code, cost, _, to in _edits("", q)])
    need = [b for b in low for _ in range(STATES)]
    cost, labels = cheapest(edges, [*need, START], {n * STATES + q for q in ENDS})
    tail = "".join(labels[n:])
    return labels[:n], INSERT * len(tail), tail


# --- Spark ---


@pandas_udf(PATHS)
def _paths(kinds: pd.Series, edge: pd.Series) -> pd.Series:
    return pd.Series([(part_paths if e else whole_paths)(k) for k, e in zip(kinds, edge)], dtype=object)


@pandas_udf(WAYS)
def _chosen(parts: pd.Series) -> pd.Series:
    """For each part of a conversation, in order: its cost, illegal neighbours across its start, its entry and exit state,
    and the turns inserted after it."""
    out = []
    for of in parts:
        of = list(of)
        ways, tail_cost, tail = through_parts([list(x["paths"]) for x in of])
        rows, before = [], None
        for x, way in zip(of, ways):
            path = next(p for p in x["paths"] if (p["enter"], p["leave"]) == way)
            crossing = before is not None and before + x["first"] not in ("su", "ua", "au")
            rows.append({"at": x["at"], "cost": path["cost"], "crossing": int(crossing), "way": f"{way[0]}{way[1]}", "tail": ""})
            before = x["last"]
        rows[-1] |= {"cost": rows[-1]["cost"] + tail_cost, "tail": tail}
        out.append(rows)
    return pd.Series(out, dtype=object)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows (conv_id, turn, role, text) with faults put in by a checksum of conversation and turn: rows dropped, texts
    emptied, end marks removed, rows repeated, roles set to user. Nulls count as one space."""
    cols = [F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]]
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    case = F.crc32(key.cast("binary")) % 20
    return (
        df.select(*cols)
        .withColumn("_case", case)
        .where("_case <> 0")
        .withColumn("_copy", F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id", "turn",
            F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        )
    )


def _joined(rows: Column, field: str) -> Column:
    return F.array_join(F.transform(F.sort_array(rows), lambda x: x[field]), "")


class Repair:
    """``report`` has one row a conversation, ``turns`` the repaired turns with their place.

    ``report``: conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (rows
    by first fault), illegal (neighbouring roles that may not follow each other), cost, audit (initials of the edits).
    ``turns``: conv_id, position, place (order of turns at one position), edit (the code), role, text.
    """

    def __init__(self, df: DataFrame, block_rows: int = BLOCK_ROWS):
        text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
        order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
        rows = df.select("conv_id", "turn", *text).withColumn("_tie", F.monotonically_increasing_id())
        self.rows = ranked(rows, order, "pos")
        self.segments = stored(self._solved(self._segments(block_rows)), "repair-segments")

    def _segments(self, block_rows: int) -> DataFrame:
        end = F.rtrim("text", F.lit(SPACES))
        initial = F.substring("role", 1, 1)
        firsts = self.rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
        narrow = self.rows.select("pos", "conv_id", initial.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("late"))
        known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
        fault = F.when(F.col("blank"), "b").when(F.col("fresh").isNull(), "d").when(F.col("late"), "t").otherwise("-")
        faults = narrow.join(firsts, "pos", "left").select("pos", "conv_id", "initial", fault.alias("fault"))
        known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
        kind = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(known)).otherwise(known)
        block = F.floor(F.col("pos") / block_rows)
        # places of the total order: a group holds at most the rows of one block
        found = faults.groupBy("conv_id", block.alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", kind.alias("kind"), "initial"))).alias("seen"),
            F.min("pos").alias("at"), F.max("pos").alias("to"),
            *[F.count_if(F.col("fault") == c).alias(n) for c, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        )
        pairs = F.zip_with(F.slice("seen", 1, F.size("seen") - 1), F.slice("seen", 2, F.size("seen") - 1), lambda a, b: F.concat(a["initial"], b["initial"]))
        edge = (F.col("at") % block_rows == 0) | (F.col("to") % block_rows == block_rows - 1)
        return found.select(
            "conv_id", "at", "blank", "duplicate", "truncated",
            F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("bigint").alias("illegal"),
            F.element_at("seen", 1)["initial"].alias("first"), F.element_at("seen", -1)["initial"].alias("last"),
            edge.alias("edge"), _paths(F.array_join(F.transform("seen", lambda x: x["kind"]), ""), edge).alias("paths"),
        )

    @staticmethod
    def _solved(segments: DataFrame) -> DataFrame:
        """One code and cost a segment."""
        segments = stored(segments, "repair-paths")
        out = ["conv_id", "at", "blank", "duplicate", "truncated", "illegal", "cost", "code"]
        inner = segments.where(~F.col("edge")).withColumns({"cost": F.col("paths")[0]["cost"], "code": F.col("paths")[0]["code"]}).select(*out)
        edge = segments.where("edge")
        # of a conversation that crosses blocks only costs meet, one small row for each block
        part = F.struct("at", "first", "last", F.transform("paths", lambda p: F.struct(p["enter"].alias("enter"), p["leave"].alias("leave"), p["cost"].alias("cost"), p["place"].alias("place"))).alias("paths"))
        ways = edge.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(F.explode(_chosen("parts")).alias("way")).select("way.*")
        chosen = F.filter("paths", lambda p: F.concat(p["enter"].cast("string"), p["leave"].cast("string")) == F.col("way"))[0]["code"]
        across = edge.join(ways, "at").withColumns({"illegal": F.col("illegal") + F.col("crossing"), "code": F.concat(chosen, F.col("tail"))}).select(*out)
        return inner.unionByName(across)

    @property
    def report(self) -> DataFrame:
        sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
        audit = F.translate(_joined(F.collect_list(F.struct("at", "code")), "code"), "uaUA", "IIRR")
        found = self.segments.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums], audit.alias("audit"))
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        gaps = self.rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps")).withColumnRenamed("conv_id", "_conv")
        return found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", *sums, "audit")

    @property
    def turns(self) -> DataFrame:
        # a row's edit with the turns inserted before it, or turns inserted after the last row
        tokens = self.segments.select("conv_id", "at", F.posexplode(F.regexp_extract_all("code", F.lit("[ua]*[DKUA]|[ua]+"), F.lit(0))).alias("nth", "token"))
        letter = F.right("token", F.lit(1))
        steps = tokens.select("conv_id", (F.col("at") + F.col("nth")).alias("position"), F.posexplode(F.split("token", "")).alias("place", "edit")).where("edit <> '' and edit <> 'D'")
        of_row = self.rows.select(F.col("pos"), F.col("role").alias("_role"), "text")
        own = F.col("edit").isin("K", "U", "A")
        joined = steps.withColumn("pos", F.when(own, F.col("position"))).join(of_row, "pos", "left")
        role = F.when(F.col("edit") == "K", F.col("_role")).when(F.lower("edit") == "u", "user").otherwise("assistant")
        return joined.select("conv_id", "position", "place", "edit", role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def digests(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for every conversation id of ``df``, which is damaged and then repaired: the report and a checksum of the repaired turns."""
    fixed = Repair(damage(df), block_rows)
    line = F.struct("position", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    hashed = fixed.turns.groupBy("conv_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha")).withColumnRenamed("conv_id", "_conv")
    report = fixed.report.withColumnRenamed("conv_id", "_id")
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        df.select("conv_id").distinct()
        .join(report, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
        .join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .select(
            "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
