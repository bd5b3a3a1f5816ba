"""Report queries over methods, models and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.text import percent, stars
from ..operators import report as r
from ..operators.curate import display_order
from ..operators.metrics import METRICS, all_metrics
from ..operators.quality import missing_cells
from ..plans import report_tables as plans
from .registry import cte, long_sql, metrics_sql, query, rd, rounded, rounded_metrics

KEYS = ["method", "vlm", "seed"]
MAIN = r.MAIN_METRICS
LONG = {"P": fx.P_SQL, **metrics_sql(KEYS), "L": long_sql(KEYS, METRICS)}


def long(spark, d):
    return plans.long_metrics(fx.predictions(spark, d))


def renamed(spark, d, column, names):
    """The methods of the fixture under the names of report variants."""
    mapping = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"m{i}"), F.lit(n))])
    out = long(spark, d).withColumn(column, F.try_element_at(mapping, F.col("method")))
    return out.where(F.col(column).isNotNull()).drop("method")


def renamed_sql(column, names):
    cases = " ".join(f"when 'm{i}' then '{n}'" for i, n in enumerate(names))
    return f"select * from (select case method {cases} end as {column}, vlm, seed, metric, value from L) where {column} is not null"


def pivot_sql(metrics, agg="avg", source="value"):
    return ", ".join(f"{rd(f'{agg}(case when metric = {chr(39)}{m}{chr(39)} then {source} end)')} as {m}" for m in metrics)


@query("a01_long_metrics", cte(f"select method, vlm, seed, metric, {rd('value')} as value from L", **LONG))
def a01(spark, d):
    return rounded(long(spark, d))


@query("a02_per_model_mean", cte(f"select method, vlm, metric, {rd('avg(value)')} as value from L group by method, vlm, metric", **LONG))
def a02(spark, d):
    return rounded(r.per_model_mean(long(spark, d), ["method"]))


PER = "select method, vlm, metric, avg(value) as value from L group by method, vlm, metric"


@query("a03_mean_of_means", cte(f"select method, {pivot_sql(MAIN)} from ({PER}) group by method", **LONG))
def a03(spark, d):
    return rounded(r.mean_of_means(long(spark, d), ["method"]))


@query("a04_std_of_means", cte(f"select method, {pivot_sql(MAIN, 'stddev_pop')} from ({PER}) group by method", **LONG))
def a04(spark, d):
    return rounded(r.std_of_means(long(spark, d), ["method"]))


VLMS = [f"v{i}" for i in range(5)]


@query(
    "a05_method_by_model",
    cte("select method, " + ", ".join(f"{rd(f'avg(case when vlm = {chr(39)}{v}{chr(39)} then value end)')} as {v}" for v in VLMS)
        + " from L where metric = 'auroc' group by method", **LONG),
)
def a05(spark, d):
    return rounded(r.pivot_metric(long(spark, d), "auroc", values=VLMS))


def position_sql(column, order):
    return f"cast(case {column} " + " ".join(f"when '{v}' then {i + 1}" for i, v in enumerate(order)) + " end as int)"


def percent_sql(expr):
    return f"format('{{:.2f}}', round(({expr}) * 100, 9))"


# five methods for four variants: the first has the runs of two
_VARIANTS = [*r.VARIANT_ORDER, r.VARIANT_ORDER[0]]


@query(
    "a06_variant_table",
    cte(
        f"select variant, {position_sql('variant', r.VARIANT_ORDER)} as position, {pivot_sql(MAIN)} from ("
        f"select variant, vlm, metric, avg(value) as value from V group by variant, vlm, metric) group by variant",
        **LONG, V=renamed_sql("variant", _VARIANTS),
    ),
)
def a06(spark, d):
    table = r.mean_of_means(renamed(spark, d, "variant", _VARIANTS), ["variant"])
    return rounded(display_order(table, "variant", r.VARIANT_ORDER))


@query(
    "a07_null_view_table",
    cte(f"select null_type, {pivot_sql(r.NULL_METRICS)} from V where vlm = 'v1' group by null_type",
        **LONG, V=renamed_sql("null_type", r.NULL_ORDER)),
)
def a07(spark, d):
    return rounded(r.null_table(renamed(spark, d, "null_type", r.NULL_ORDER), "v1"))


@query(
    "a08_mean_std",
    cte(f"select method, vlm, metric, {rd('avg(value)')} as mean, {rd('stddev_samp(value)')} as std, count(value) as n from L group by method, vlm, metric", **LONG),
)
def a08(spark, d):
    return rounded(r.mean_std(long(spark, d), ["method", "vlm", "metric"]))


# zero differences go; the p-value counts the sign patterns of the (tied) ranks, of which there are at most 32
_SIGNED = f"""select vlm, metric, method, n_pairs, cast(n as int) as n, w, case when n > 0 then {rd("""least(1.0, 2.0 * len(list_filter(range(cast(pow(2, n) as int)),
    lambda s: list_sum(list_transform(ranks, lambda r, i: case when (s >> cast(i - 1 as int)) & 1 = 1 then r else 0.0 end)) <= w)) / pow(2, n))""")} end as p
from (select vlm, metric, method, count(*) as n_pairs, count(*) filter (d <> 0) as n, list(rk) filter (d <> 0) as ranks,
    least(sum(case when d > 0 then rk else 0 end), sum(case when d < 0 then rk else 0 end)) as w
  from (select *, cast(rank() over (partition by vlm, metric, method, d = 0 order by abs(d)) as double)
        + (count(*) over (partition by vlm, metric, method, abs(d)) - 1) / 2.0 as rk
    from (select a.vlm, a.metric, a.method, b.value - a.value as d
      from R a join R b using (vlm, metric, seed) where a.method <> 'm0' and b.method = 'm0'))
  group by vlm, metric, method)"""


@query("a09_signed_rank", cte(_SIGNED, **LONG, R=f"select method, vlm, seed, metric, {rd('value')} as value from L"))
def a09(spark, d):
    return rounded(r.signed_rank(rounded(long(spark, d)), ["vlm", "metric"], "method", "m0"))


@query(
    "a10_delta_to_base",
    cte(
        f"""select vlm, method, metric, {rd("case when metric in ('ece', 'brier') then b - v else v - b end")} as delta from (
  select vlm, method, metric, avg(value) as v from L where method <> 'm0' group by vlm, method, metric)
join (select vlm, metric, avg(value) as b from L where method = 'm0' group by vlm, metric) using (vlm, metric)""",
        **LONG,
    ),
)
def a10(spark, d):
    return rounded(r.delta(long(spark, d), ["vlm"], "method", "m0"))


_VALUES = ["accuracy", "ece", "brier", "precision", "recall", "f1", "auroc", "aucpr"]


@query(
    "a11_seed_ensemble",
    cte(rounded_metrics(["method", "vlm"], _VALUES, ["n_samples"]), P0=fx.P_SQL,
        P="select method, vlm, sample_id, avg(c) as c, max(y) as y from P0 group by method, vlm, sample_id",
        **metrics_sql(["method", "vlm"])),
)
def a11(spark, d):
    # five seeds of one score differ by whole hundredths, so means carry rounding noise: settle it first
    P = fx.predictions(spark, d)
    return rounded(r.seed_ensemble(P, ["method", "vlm"]).select("method", "vlm", "n_samples", *_VALUES))


@query(
    "a12_run_summary",
    cte(f"""select method, vlm, metric, {rd('avg(value)')} as mean, {rd('stddev_samp(value)')} as std, {rd('min(value)')} as "min", {rd('max(value)')} as "max"
from L group by method, vlm, metric""", **LONG),
)
def a12(spark, d):
    return rounded(r.run_summary(long(spark, d), ["method", "vlm", "metric"]))


@query(
    "a13_formatted_table",
    cte(
        "select method, " + ", ".join(f"format('{{:.2f}}', {m} * 100 + 1.2345e-9) as {m}" for m in MAIN)
        + f", case when auroc < 0.001 then '<0.001***' when auroc < 0.01 then concat(format('{{:.3f}}', auroc), '**') when auroc < 0.05 then concat(format('{{:.3f}}', auroc), '*') else format('{{:.3f}}', auroc) end as stars"
        + f" from (select method, {pivot_sql(MAIN)} from ({PER}) group by method)",
        **LONG,
    ),
)
def a13(spark, d):
    table = rounded(r.mean_of_means(long(spark, d), ["method"]))
    shown = {m: percent(F.col(m) + F.lit(1.2345e-11)) for m in MAIN}
    return table.withColumn("stars", stars(F.col("auroc"))).withColumns(shown)


@query(
    "a14_seed_audit",
    cte(
        """select method, vlm, cast(count(*) as int) as n_used, string_agg(cast(seed as varchar), ',' order by seed) as used,
  array_to_string(list_filter([2, 3, 5, 8], lambda s: not list_contains(list(seed), s)), ',') as missing
from (select distinct method, vlm, seed from P) group by method, vlm""",
        P=fx.P_SQL,
    ),
)
def a14(spark, d):
    return r.seed_audit(fx.predictions(spark, d), ["method", "vlm"], [2, 3, 5, 8])


@query(
    "u12_display_order",
    cte(f"select method, {rd('avg(c)')} as mean_c, {position_sql('method', ['m3', 'm1', 'm4', 'm0', 'm2'])} as position from P group by method", P=fx.P_SQL),
)
def u12(spark, d):
    means = fx.predictions(spark, d).groupBy("method").agg(F.avg("c").alias("mean_c"))
    return rounded(display_order(means, "method", ["m3", "m1", "m4", "m0", "m2"]))


@query(
    "q16_missing_cells",
    cte(
        """select method, vlm, seed from (select unnest(['m0', 'm1', 'm2', 'm3', 'm4', 'm5']) as method)
cross join (select unnest(['v0', 'v1', 'v2', 'v3', 'v4']) as vlm) cross join (select unnest([1, 2, 6]) as seed)
except select method, vlm, seed from P""",
        P=fx.P_SQL,
    ),
)
def q16(spark, d):
    dims = {"method": [f"m{i}" for i in range(6)], "vlm": VLMS, "seed": [1, 2, 6]}
    return missing_cells(fx.predictions(spark, d), dims)


@query("a00_main_table_from_predictions")
def a00(spark, d):
    return plans.main_table(long(spark, d), [f"m{i}" for i in range(5)])


@query("a00_null_comparison")
def a00_null(spark, d):
    return rounded(plans.null_comparison(renamed(spark, d, "null_type", r.NULL_ORDER).where("vlm = 'v1'")))
