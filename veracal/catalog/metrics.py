"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import metrics as m
from .registry import COUNTS, VALUES, cte, metrics_sql, query, rd, rounded, rounded_metrics

BY = ["method", "vlm", "seed"]
G = ", ".join(BY)
P_METRICS = metrics_sql(BY)
S_METRICS = metrics_sql(["g"], "S")


def metric_cte(body: str, **extra: str) -> str:
    return cte(body, P=fx.P_SQL, **P_METRICS, **extra)


@query("m01_ece", metric_cte(f"select {G}, n_samples as n, {rd('ece')} as ece from met"))
def m01(spark, d):
    return rounded(m.ece(fx.predictions(spark, d), BY))


@query("m01_ece_zero_scores", cte(f"select g, n_samples as n, {rd('ece')} as ece from met", S=fx.SCORES_SQL, **S_METRICS))
def m01_zero(spark, d):
    return rounded(m.ece(fx.scores(spark, d), ["g"]))


def _reliability_sql(g: str) -> str:
    return f"""with P as ({fx.P_SQL}),
edges as (select i as bin, i * cast(0.1 as double) as lo,
  case when i = 9 then cast(1.0 as double) else (i + 1) * cast(0.1 as double) end as hi from (select unnest(range(10)) as i)),
named as (select distinct {g} from P),
filled as (select {g}, bin, count(*) as n, avg(cast(y as double)) as acc from P join edges
  on c >= lo and (c < hi or (bin = 9 and c <= hi)) group by {g}, bin)
select {g}, cast(bin as int) as bin, {rd('(lo + hi) / 2')} as center, coalesce(n, 0) as n,
  coalesce({rd('acc')}, cast('nan' as double)) as accuracy
from named cross join edges left join filled using ({g}, bin)"""


@query("m02_reliability_curve", _reliability_sql("method, vlm"))
def m02(spark, d):
    return rounded(m.reliability(fx.predictions(spark, d), ["method", "vlm"]))


@query("m03_pooled_reliability", _reliability_sql("method"))
def m03(spark, d):
    return rounded(m.reliability(fx.predictions(spark, d), ["method"]))


@query("m04_brier", metric_cte(f"select {G}, {rd('brier')} as brier from met"))
def m04(spark, d):
    return rounded(m.brier(fx.predictions(spark, d), BY))


@query("m05_confusion", metric_cte(f"select {G}, tp, fp, tn, fn, {rd('accuracy')} as accuracy from met"))
def m05(spark, d):
    return rounded(m.confusion(fx.predictions(spark, d), BY))


@query(
    "m06_precision_recall",
    cte(
        f"""select dataset, {rd('case when tp + fp > 0 then tp / cast(tp + fp as double) else 0.0 end')} as "precision",
  {rd('case when tp + fn > 0 then tp / cast(tp + fn as double) else 0.0 end')} as recall,
  {rd('case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0.0 end')} as f1,
  {rd('case when tp + fn > 0 then tp / cast(tp + fn as double) else 0.0 end')} as sensitivity,
  {rd('case when tn + fp > 0 then tn / cast(tn + fp as double) else 0.0 end')} as specificity from met""",
        P=fx.P_SQL, **metrics_sql(["dataset"]),
    ),
)
def m06(spark, d):
    return rounded(m.prf(fx.predictions(spark, d), ["dataset"]))


@query("m07_auroc", metric_cte(f"select {G}, {rd('auroc')} as auroc from met"))
def m07(spark, d):
    return rounded(m.auroc(fx.predictions(spark, d), BY))


@query("m07_auroc_one_group", cte(f"select {rd('auroc')} as auroc from met", P=f"select 1 as one, * from ({fx.P_SQL})",
                                  **metrics_sql(["one"])))
def m07_one(spark, d):
    return rounded(m.auroc(fx.predictions(spark, d), []))


@query("m07_auroc_ties", cte(f"select g, {rd('auroc')} as auroc from met", S=fx.SCORES_SQL, **S_METRICS))
def m07_ties(spark, d):
    return rounded(m.auroc(fx.scores(spark, d), ["g"]))


@query("m08_aucpr", metric_cte(f"select {G}, {rd('aucpr')} as aucpr from met"))
def m08(spark, d):
    return rounded(m.aucpr(fx.predictions(spark, d), BY))


@query("m08_aucpr_ties", cte(f"select g, {rd('aucpr')} as aucpr from met", S=fx.SCORES_SQL, **S_METRICS))
def m08_ties(spark, d):
    return rounded(m.aucpr(fx.scores(spark, d), ["g"]))


@query("m09_average_precision", metric_cte(f"select {G}, {rd('average_precision')} as average_precision from met"))
def m09(spark, d):
    return rounded(m.average_precision(fx.predictions(spark, d), BY))


@query("m10_single_class", cte(rounded_metrics(["dataset"]), P=fx.P_SQL, **metrics_sql(["dataset"])))
def m10(spark, d):
    return rounded(m.all_metrics(fx.predictions(spark, d), ["dataset"]).select("dataset", *COUNTS, *VALUES))


_EMPTY = {"ece": "1.0", "brier": "1.0", "auroc": "0.5"}


@query(
    "m11_empty_groups",
    cte(
        "select name as dataset, coalesce(n_samples, 0) as n_samples, "
        + ", ".join(f'coalesce({rd(chr(34) + v + chr(34))}, {_EMPTY.get(v, "0.0")}) as "{v}"' for v in VALUES)
        + " from (select distinct dataset as name from P union all select distinct event_type from events) left join met on name = dataset",
        P=fx.P_SQL, **metrics_sql(["dataset"]),
    ),
)
def m11(spark, d):
    P = fx.predictions(spark, d)
    groups = P.select("dataset").unionByName(fx.table(spark, d, "events").select(F.col("event_type").alias("dataset"))).distinct()
    return rounded(m.all_metrics(P, ["dataset"], groups=groups).select("dataset", "n_samples", *VALUES))


def _level(name: int, by: list[str], source: str) -> str:
    inner = cte(rounded_metrics(by), **metrics_sql(by, source))
    cols = ", ".join(f'"{c}"' for c in COUNTS + VALUES)
    keys = ", ".join(k if k in by else f"cast(null as varchar) as {k}" for k in ("dataset", "category"))
    return f"select cast({name} as int) as level, {keys}, {cols} from ({inner})"


@query(
    "m12_metrics_by_groups",
    cte(
        " union all ".join([_level(0, ["one"], "P"), _level(1, ["dataset"], "P"), _level(2, ["dataset", "category"], "P")]),
        P=f"select 1 as one, * from ({fx.P_SQL})",
    ),
)
def m12(spark, d):
    out = m.metrics_by_groups(fx.predictions(spark, d), ["dataset", "category"])
    return rounded(out.select("level", "dataset", "category", *COUNTS, *VALUES))


_GUARD_DIM = "select p_partkey as sample_id, p_brand as dataset from part"
_GUARD_P = f"select p.sample_id, y, c, coalesce(t.dataset, 'unknown') as dataset from ({fx.P_SQL}) p left join ({_GUARD_DIM}) t on t.sample_id = p.sample_id * 7"


@query(
    "m13_guarded_metrics",
    cte(
        f"""select dataset, n_samples, n_pos as n_correct,
  case when n_pos = 0 or n_neg = 0 then 'single_class_in_subset' end as error, """
        + ", ".join(f'case when n_pos > 0 and n_neg > 0 then {rd(chr(34) + v + chr(34))} end as "{v}"' for v in VALUES)
        + ", " + ", ".join(f"case when n_pos > 0 and n_neg > 0 then {k} end as {k}" for k in ("tp", "tn", "fp", "fn"))
        + " from met",
        P=_GUARD_P, **metrics_sql(["dataset"]),
    ),
)
def m13(spark, d):
    dim = fx.table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("dataset"))
    P = fx.predictions(spark, d).withColumn("sample_id", F.col("sample_id") * 7)
    return rounded(m.guarded_metrics(P, dim))


_YOUDEN = f"""select {G}, {rd('tau')} as tau, {rd('sens')} as sens, {rd('spec')} as spec, {rd('j')} as j from (
  select *, row_number() over (partition by {G} order by j desc, i) as k from (
    select *, sens + spec - 1.0 as j from (
      select {G}, i, i * cast(0.001 as double) as tau, tp / (tp + (np - tp) + cast(1e-12 as double)) as sens,
        (nn - fp) / ((nn - fp) + fp + cast(1e-12 as double)) as spec
      from (select {G}, i, np, nn, sum(case when c >= i * cast(0.001 as double) then pos else 0 end) as tp,
              sum(case when c >= i * cast(0.001 as double) then neg else 0 end) as fp
            from hh join aa using ({G}) cross join (select unnest(range(1001)) as i) group by {G}, i, np, nn)))
  ) where k = 1"""


@query("m14_youden", metric_cte(_YOUDEN))
def m14(spark, d):
    return rounded(m.youden(fx.predictions(spark, d), BY))


@query(
    "m15_sens_spec",
    cte(
        f"""select {G}, {rd('tp / (tp + fn + cast(1e-12 as double))')} as sens,
  {rd('tn / (tn + fp + cast(1e-12 as double))')} as spec from met""",
        P=fx.P_SQL, **metrics_sql(BY, threshold=0.37),
    ),
)
def m15(spark, d):
    return rounded(m.sens_spec(fx.predictions(spark, d), BY, 0.37))


def _score(name):
    def run(spark, d):
        return rounded(m.validation_score(fx.predictions(spark, d), BY, name))

    return run


query("m16_composite_score", metric_cte(f"select {G}, {rd('0.6 * auroc + 0.4 * (1.0 - ece)')} as score from met"))(_score("composite"))
query("m17_penalised_auroc", metric_cte(f"select {G}, {rd('auroc * (1.0 - ece)')} as score from met"))(_score("auroc_with_constraint"))


@query(
    "m18_constrained_composite",
    metric_cte(
        f"""select {G}, case when sens >= 0.5 and spec >= 0.4 then {rd('0.6 * auroc + 0.4 * (1.0 - ece)')}
  else cast('-inf' as double) end as score from met join ({_YOUDEN}) using ({G})"""
    ),
)
def m18(spark, d):
    return rounded(m.validation_score(fx.predictions(spark, d), BY, "composite_with_constraints", min_sens=0.5, min_spec=0.4))


_BCE = f"select {G}, -avg(y * ln(c + 1e-7) + (1 - y) * ln(1 - c + 1e-7)) as bce from P group by {G}"


@query(
    "m19_validation_score",
    metric_cte(
        f"""select {G}, 'auroc' as name, {rd('auroc')} as score from met union all
select {G}, 'ece' as name, {rd('1.0 - ece')} as score from met union all
select {G}, 'validation_loss' as name, {rd('-bce')} as score from ({_BCE})"""
    ),
)
def m19(spark, d):
    P = fx.predictions(spark, d)
    parts = [
        m.validation_score(P, BY, name).withColumn("name", F.lit(name)) for name in ("auroc", "ece", "validation_loss")
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("m20_bce", cte(f"select {G}, {rd('bce')} as bce from ({_BCE})", P=fx.P_SQL))
def m20(spark, d):
    return rounded(m.bce(fx.predictions(spark, d), BY))


@query(
    "m21_confidence_summary",
    cte(f"""select {G}, {rd('avg(c)')} as mean, {rd('stddev_pop(c)')} as std, {rd('min(c)')} as "min", {rd('max(c)')} as "max"
from P group by {G}""", P=fx.P_SQL),
)
def m21(spark, d):
    return rounded(m.confidence_summary(fx.predictions(spark, d), BY))


@query(
    "m22_class_weight",
    cte(f"""select dataset, {rd('case when sum(y) > 0 then sum(1 - y) / cast(sum(y) as double) else 1.0 end')} as pos_weight
from P group by dataset""", P=fx.P_SQL),
)
def m22(spark, d):
    return rounded(m.pos_weight(fx.predictions(spark, d), ["dataset"]))


@query("m23_label_flip", cte(rounded_metrics(BY), P=f"select method, vlm, seed, 1 - y as y, 1.0 - c as c from ({fx.P_SQL})", **P_METRICS))
def m23(spark, d):
    return rounded(m.all_metrics(m.flip(fx.predictions(spark, d)), BY).select(*BY, *COUNTS, *VALUES))


@query(
    "m24_predicted_flags",
    cte(f"""select sample_id, method, vlm, seed, cast(c >= 0.5 as int) as predicted, cast((c >= 0.5) = (y = 1) as int) as is_match from P""", P=fx.P_SQL),
)
def m24(spark, d):
    return m.predict(fx.predictions(spark, d)).select("sample_id", *BY, "predicted", "is_match")


@query(
    "m25_coverage",
    cte(
        f"""select method, vlm, coalesce(k, 0) as n_scored, n_total, {rd('coalesce(k, 0) / cast(n_total as double)')} as coverage
from (select method, vlm, n_total from (select distinct method from P) cross join
  (select vlm, 5 * count(distinct floor(event_id / 5)) as n_total from (select *, concat('v', cast(cast(floor(event_id / 5) as bigint) % 5 as varchar)) as vlm from events) group by vlm))
left join (select method, vlm, count(*) as k from P group by method, vlm) using (method, vlm)""",
        P=fx.P_SQL,
    ),
)
def m25(spark, d):
    P = fx.predictions(spark, d)
    listed = fx.table(spark, d, "events").select(F.expr("event_id div 5").alias("s")).distinct()
    totals = listed.groupBy(F.concat(F.lit("v"), F.col("s") % 5).alias("vlm")).agg((F.count("*") * 5).alias("n_total"))
    cells = totals.withColumn("method", F.explode(F.array(*[F.lit(f"m{i}") for i in range(5)])))
    return rounded(m.coverage(P, cells.select("method", "vlm", "n_total"), ["method", "vlm"]))


@query("m00_all_metrics", metric_cte(rounded_metrics(BY)))
def m00(spark, d):
    return rounded(m.all_metrics(fx.predictions(spark, d), BY).select(*BY, *COUNTS, *VALUES))
