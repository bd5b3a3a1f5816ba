"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an operator id, with its check where SQL can express one."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# Moves exact decimal halves off the rounding edge, where the last bit of a sum would decide.
NUDGE = 1.2345e-11


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def cte(body: str, **tables: str) -> str:
    parts = ",\n".join(f"{name} as ({sql})" for name, sql in tables.items())
    return f"with {parts}\n{body}"


def rd(expr: str, digits: int = 9) -> str:
    return f"(round(({expr}) + cast({NUDGE} as double), {digits}) + 0.0)"


def metrics_sql(by: list[str], source: str = "P", threshold: float = 0.5) -> dict[str, str]:
    """CTEs ending in ``met``: every metric per group, written with windows over all rows."""
    g = ", ".join(by)
    t = f"cast({threshold} as double)"
    return {
        "bins": "select i, i * cast(0.1 as double) as lo, (i + 1) * cast(0.1 as double) as hi from (select unnest(range(10)) as i)",
        "hh": f"select {g}, c, sum(y) as pos, sum(1 - y) as neg from {source} group by {g}, c",
        "rr": f"""select *, sum(pos) over (partition by {g} order by c desc rows unbounded preceding) as tp,
  sum(neg) over (partition by {g} order by c desc rows unbounded preceding) as fp from hh""",
        "aa": f"""select {g}, sum(pos) as np, sum(neg) as nn,
  sum(cast(tp - pos as double) * neg + 0.5 * pos * neg) as pairs,
  sum(pos * (tp / cast(tp + fp as double) + case when tp + fp - pos - neg > 0
    then (tp - pos) / cast(tp + fp - pos - neg as double) else 1.0 end) / 2.0) as area,
  sum(pos * (tp / cast(tp + fp as double))) as steps from rr group by {g}""",
        "ee": f"""select {g}, sum(abs(ac - ay) * k) as gap from (
  select {g}, i, avg(c) as ac, avg(cast(y as double)) as ay, count(*) as k
  from {source} join bins on c > lo and c <= hi group by {g}, i) group by {g}""",
        "ss": f"""select {g}, count(*) as n, avg((c - y) * (c - y)) as brier,
  sum(case when c >= {t} and y = 1 then 1 else 0 end) as tp, sum(case when c >= {t} and y = 0 then 1 else 0 end) as fp,
  sum(case when c < {t} and y = 0 then 1 else 0 end) as tn, sum(case when c < {t} and y = 1 then 1 else 0 end) as fn
  from {source} group by {g}""",
        "met": f"""select {g}, n as n_samples, (tp + tn) / cast(n as double) as accuracy, coalesce(gap, 0) / n as ece, brier,
  case when np = 0 or nn = 0 then flawless when tp + fp > 0 then tp / cast(tp + fp as double) else 0.0 end as "precision",
  case when np = 0 or nn = 0 then flawless else tp / cast(tp + fn as double) end as recall,
  case when np = 0 or nn = 0 then flawless else 2 * tp / cast(2 * tp + fp + fn as double) end as f1,
  case when np = 0 or nn = 0 then flawless else tp / cast(tp + fn as double) end as sensitivity,
  case when np = 0 or nn = 0 then flawless else tn / cast(tn + fp as double) end as specificity,
  case when np = 0 or nn = 0 then 0.5 else pairs / (cast(np as double) * nn) end as auroc,
  case when np = 0 or nn = 0 then np / cast(n as double) else area / np end as aucpr,
  case when np = 0 or nn = 0 then 0.0 else steps / np end as average_precision,
  cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(tn as bigint) as tn, cast(fn as bigint) as fn,
  cast(np as bigint) as n_pos, cast(nn as bigint) as n_neg
  from (select *, case when fp + fn = 0 then 1.0 else 0.0 end as flawless
        from ss join aa using ({g}) left join ee using ({g}))""",
    }


VALUES = [
    "accuracy", "ece", "brier", "precision", "recall", "f1", "sensitivity", "specificity", "auroc", "aucpr",
]
COUNTS = ["n_samples", "tp", "fp", "tn", "fn"]


def rounded_metrics(by: list[str], values: list[str] = VALUES, counts: list[str] = COUNTS) -> str:
    cols = by + counts + [f'{rd(chr(34) + v + chr(34))} as "{v}"' for v in values]
    return "select " + ", ".join(cols) + " from met"


def long_sql(keys: list[str], values: list[str]) -> str:
    """Wide metrics to (keys, metric, value)."""
    return " union all ".join(
        f"""select {', '.join(keys)}, '{v}' as metric, "{v}" as value from met""" for v in values
    )
