"""Probe loss, training and trial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import probe as p, search as sr
from ..operators.metrics import all_metrics
from .registry import cte, metrics_sql, query, rd, rounded

WEIGHTS = [((i * 5) % 11 - 5) / 4.0 for i in range(64)]
LOGIT = "list_sum(list_transform({v}, lambda x, i: x * (((i - 1) * 5) % 11 - 5) / 4.0)) + 0.1"

LOSS = {
    "V": fx.VIEWS_SQL,
    "LZ": f"select y, mask, {LOGIT.format(v='h_base')} as z, {LOGIT.format(v='h_blank')} as zk from V",
    "LP": "select *, 1 / (1 + exp(-z)) as p, 1 / (1 + exp(-zk)) as pk from LZ",
    "LT": """select avg(-(pw * y * ln(p) + (1 - y) * ln(1 - p))) as bce, avg((p - y) * (p - y)) as brier,
  sum(greatest(0.0, 0.1 - (p - pk)) * y * mask) / (sum(y * mask) + 1e-8) as rank
from LP cross join (select sum(1 - y) / cast(sum(y) as double) as pw from V)""",
}


def _loss(spark, d, variant):
    return p.probe_loss(fx.views(spark, d), WEIGHTS, 0.1, variant, beta=0.7, lam=0.3)


@query("l01_weighted_bce", cte(f"select {rd('bce')} as bce from LT", **LOSS))
def l01(spark, d):
    return rounded(_loss(spark, d, "bce_only").select("bce"))


@query("l02_brier_term", cte(f"select {rd('0.7 * brier')} as brier_term from LT", **LOSS))
def l02(spark, d):
    return rounded(_loss(spark, d, "full").select((F.col("brier") * 0.7).alias("brier_term")))


@query("l03_rank_hinge", cte(f"select {rd('0.3 * rank')} as rank_term from LT", **LOSS))
def l03(spark, d):
    return rounded(_loss(spark, d, "full").select((F.col("rank") * 0.3).alias("rank_term")))


@query(
    "l04_loss_variants",
    cte(f"""select 'full' as variant, {rd('bce + 0.7 * brier + 0.3 * rank')} as loss from LT union all select 'no_rank', {rd('bce + 0.7 * brier')} from LT
union all select 'no_brier', {rd('bce + 0.3 * rank')} from LT union all select 'bce_only', {rd('bce')} from LT""", **LOSS),
)
def l04(spark, d):
    return rounded(p.loss_variants(fx.views(spark, d), WEIGHTS, 0.1, beta=0.7, lam=0.3))


def _descent(configs: list[sr.Config], steps: int, rows: str) -> dict[str, str]:
    """Named queries of the same gradient descent: W0 .. Wn hold the weights of every configuration, L0 .. Ln their losses."""
    values = ", ".join(f"('{c.name}', {c.lr}::double, {c.beta}::double, {c.lam}::double, {c.margin}::double)" for c in configs)
    out = {
        "R": rows,
        "K": f"select * from (values {values}) k(config, lr, beta, lam, margin)",
        "S": "select count(*) as n, sum(1 - y) / cast(sum(y) as double) as pw, sum(y * mask) + 1e-8 as active from R",
        "W0": "select *, list_transform(range(64), lambda i: 0.0::double) as w, 0.0::double as b from K",
    }
    for t in range(steps + 1):
        out[f"Z{t}"] = f"select k.*, y, mask, h_base as x, h_blank as xk, list_inner_product(w, h_base) + b as z, 1 / (1 + exp(-(list_inner_product(w, h_base) + b))) as p, 1 / (1 + exp(-(list_inner_product(w, h_blank) + b))) as q from W{t} k cross join R"
        out[f"L{t}"] = f"""select config, {t} as step, avg(pw * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))) + any_value(beta) * avg((p - y) * (p - y))
  + any_value(lam) * sum(greatest(0.0, margin - (p - q)) * y * mask) / any_value(active) as loss from Z{t}, S group by config"""
        if t == steps:
            break
        out[f"D{t}"] = f"""select config, x, xk, ((1 - y) * p - pw * y * (1 - p)) / n + beta * 2 * (p - y) * p * (1 - p) / n - lam * active_on * p * (1 - p) as dz, lam * active_on * q * (1 - q) as dq
from (select *, case when margin - (p - q) > 0 then y * mask / active else 0.0 end as active_on from Z{t}, S)"""
        out[f"G{t}"] = f"""select config, list(g order by i) as g, any_value(gb) as gb from (
  select config, i, sum(dz * x[i] + dq * xk[i]) as g, sum(dz + dq) as gb from D{t}, (select unnest(range(1, 65)) as i) group by config, i) group by config"""
        out[f"W{t + 1}"] = f"""select config, lr, beta, lam, margin, list_transform(w, lambda x, i: x - lr * g[i] * clip) as w, b - lr * gb * clip as b
from (select *, least(1.0, 1.0 / (sqrt(list_inner_product(g, g) + gb * gb) + 1e-6)) as clip from W{t} join G{t} using (config))"""
    return out


def _fixed(body: str, **tables: str) -> str:
    """Every named query is worked out once."""
    return "with " + ",\n".join(f"{name} as materialized ({sql})" for name, sql in tables.items()) + f"\n{body}"


@query(
    "l05_linear_probe_fit",
    _fixed(" union all ".join(f"select cast(step as int) as step, {rd('loss')} as loss from L{t}" for t in range(9)), V=fx.VIEWS_SQL, **_descent([sr.Config("only")], 8, "select * from V")),
)
def l05(spark, d):
    w, b, history = p.fit_linear(fx.views(spark, d), "full", steps=8)
    rows = [(i, float(x)) for i, x in enumerate(history)]
    fitted = p.probe_loss(fx.views(spark, d), list(map(float, w)), b).select(F.lit(len(rows)).alias("step"), "loss")
    return rounded(spark.createDataFrame(rows, "step int, loss double").unionByName(fitted))


@query("l06_logistic_probe_metrics")
def l06(spark, d):
    data = fx.views(spark, d)
    model = p.fit_ml(data, "0", max_iter=20)
    return rounded(all_metrics(p.score_ml(model, data).select("y", "c"), []), 6)


@query("l06_hidden_layer_probe_metrics")
def l06_mlp(spark, d):
    data = fx.views(spark, d)
    model = p.fit_ml(data, "8", max_iter=20)
    return rounded(all_metrics(p.score_ml(model, data).select("y", "c"), []), 6)


@query(
    "l07_parameter_budget",
    """select p_partkey, layers, case when p_size % 5 = 0 then 65 else 64 * p_size + p_size + p_size * (p_size + 7) + (p_size + 7) + (p_size + 7) + 1 end as n_params
from (select p_partkey, cast(p_size as bigint) as p_size, case when p_size % 5 = 0 then '0' else concat(p_size, ',', p_size + 7) end as layers from part)
where case when p_size % 5 = 0 then 65 else 64 * p_size + p_size + p_size * (p_size + 7) + (p_size + 7) + (p_size + 7) + 1 end between 1 and 4000""",
)
def l07(spark, d):
    s = F.col("p_size")
    layers = F.when(s % 5 == 0, F.lit("0")).otherwise(F.concat_ws(",", s.cast("string"), (s + 7).cast("string")))
    parts = fx.table(spark, d, "part").select("p_partkey", layers.alias("layers"))
    return p.within_budget(parts, "layers", 64, most=4000)


@query(
    "l08_configuration_scores",
    cte("""select layers, margin, beta, cast(k as bigint) as n_params, count(*) as n from (select * from (select unnest(['0', '256', '512,256']) as layers) cross join (select unnest([0.05, 0.1]::double[]) as margin)
  cross join (select unnest([0.5, 1.0]::double[]) as beta)) join (select case label % 3 when 0 then '0' when 1 then '256' else '512,256' end as layers from E) using (layers)
join (values ('0', 65), ('256', 64 * 256 + 256 + 257), ('512,256', 64 * 512 + 512 + 512 * 256 + 256 + 257)) n(layers, k) using (layers) group by all"""
        , E="select label from embeddings"),
)
def l08(spark, d):
    grid = p.config_grid(spark, {"layers": ["0", "256", "512,256"], "margin": [0.05, 0.1], "beta": [0.5, 1.0]})
    which = F.col("label") % 3
    used = fx.table(spark, d, "embeddings").select(
        F.when(which == 0, "0").when(which == 1, "256").otherwise("512,256").alias("layers")
    )
    per = used.groupBy("layers").agg(F.count("*").alias("n"))
    counted = p.within_budget(grid, "layers", 64)
    return counted.join(per, "layers").select("layers", "margin", "beta", "n_params", "n")


GRID = [
    sr.Config(f"lr{lr}-beta{beta}-margin{margin}", lr=lr, beta=beta, lam=0.3, margin=margin)
    for lr in (0.25, 2.0) for beta in (0.2, 1.0) for margin in (0.05, 0.25)
]


@query(
    "l08_configuration_search",
    _fixed(
        f"""select config, cast(65 as bigint) as n_params, {rd('loss', 6)} as loss, {rd('auroc', 6)} as score, config = (select min(config) from met where round(auroc, 9) = (select max(round(auroc, 9)) from met)) as chosen
from met join L3 using (config)""",
        V=fx.VIEWS_SQL, **_descent(GRID, 4, "select * from V where sample_id % 4 <> 0"),
        P="select config, y, 1 / (1 + exp(-(list_inner_product(w, h_base) + b))) as c from W4 cross join V where sample_id % 4 = 0",
        **metrics_sql(["config"]),
    ),
)
def l08_search(spark, d):
    views = fx.views(spark, d)
    held = F.col("sample_id") % 4 == 0
    found, _ = sr.search(views.where(~held), views.where(held), GRID, "sample_id", steps=4)
    return rounded(found, 6)


# stop: first epoch with 20 misses since the last strict improvement; best: first epoch of the maximum up to there
_REPLAY = {
    "H": fx.HISTORY_SQL,
    "HB": "select *, max(score) over (partition by trial order by epoch rows between unbounded preceding and 1 preceding) as before from H",
    "HU": "select *, max(case when before is null or score > before then epoch end) over (partition by trial order by epoch) as last_up from HB",
    "HS": "select trial, min(case when epoch - last_up >= 20 then epoch end) as stop, max(epoch) as final from HU group by trial",
    "HK": "select trial, epoch, score, stop, coalesce(stop, final) as last_epoch from H join HS using (trial) where epoch <= coalesce(stop, final)",
    "HM": "select *, max(score) over (partition by trial) as top from HK",
}


@query(
    "l09_early_stop_replay",
    cte(f"""select trial, min(epoch) as best_epoch, {rd('any_value(top)')} as best_score, any_value(last_epoch) as last_epoch, bool_or(stop is not null) as stopped_early
from HM where score = top group by trial""", **_REPLAY),
)
def l09(spark, d):
    return rounded(p.replay_early_stop(fx.history(spark, d)))


OPERATING = """select trial, epoch, score, case when trial % 2 = 0 then 0.6 + (event_id % 3) / 10.0 else 0.4 + (event_id % 7) / 10.0 end as sens,
  case when trial % 3 = 0 then 0.45 + (event_id % 5) / 10.0 else 0.7 end as spec from H"""


@query(
    "l10_feasible_trials",
    cte("""select trial, epoch, cast(score as double) as score from O where trial not in (select trial from O where epoch >= 2 and (sens < 0.6 or spec < 0.6))""", H=fx.HISTORY_SQL, O=OPERATING),
)
def l10(spark, d):
    i, t = F.col("event_id"), F.col("trial")
    hist = fx.history(spark, d).select(
        "trial", "epoch", "score",
        F.when(t % 2 == 0, F.lit(0.6) + (i % 3) / 10.0).otherwise(F.lit(0.4) + (i % 7) / 10.0).alias("sens"),
        F.when(t % 3 == 0, F.lit(0.45) + (i % 5) / 10.0).otherwise(F.lit(0.7)).alias("spec"),
    )
    return p.drop_infeasible(hist).select("trial", "epoch", "score")
