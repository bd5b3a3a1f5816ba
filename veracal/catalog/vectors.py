"""Vector, token and trajectory queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import vectors as v
from ..operators import confidence as cf
from ..operators import sequences as sq
from ..operators import trajectory as tr
from .registry import ORACLES, cte, query, rd, rounded

KEY = ["sample_id", "token_idx"]
T = {"T": fx.TOKENS_SQL}


def lse(x):
    return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda e: exp(e - list_max({x}))))))"


# tokens with the normaliser and the probabilities of their logits
TP = {**T, "TN": f"select *, {lse('logits')} as nz from T", "TQ": "select *, list_transform(logits, lambda e: exp(e - nz)) as p from TN"}


def norm(x):
    return f"sqrt(list_sum(list_transform({x}, lambda e: e * e)))"


def wsum(x):
    """A number that depends on every element and its place."""
    return f"list_sum(list_transform({x}, lambda e, i: e * i))"


def place_sum(a):
    return F.aggregate(F.transform(a, lambda e, i: e * (i + 1)), F.lit(0.0), lambda acc, e: acc + e)


IDS_A, IDS_B = "[token_id, token_id + 7, 70, -1]", "[token_id + 20, token_id + 33]"
BEST = "list_max(list_transform(list_filter({ids}, lambda i: i >= 0 and i < 64), lambda i: logits[i + 1]))"


@query("v01_best_logit", cte(f"select sample_id, token_idx, {rd(BEST.format(ids=IDS_A))} as a, cast('-inf' as double) as none from T", **T))
def v01(spark, d):
    ids = F.array(F.col("token_id"), F.col("token_id") + 7, F.lit(70), F.lit(-1))
    return rounded(fx.tokens(spark, d).select(*KEY, v.best_logit(F.col("logits"), ids).alias("a"), v.best_logit(F.col("logits"), F.array(F.lit(99))).alias("none")))


@query(
    "v02_p_true",
    cte(f"""select sample_id, token_idx, {rd('1.0 / (1.0 + exp(a - b))')} as p_true, case when b > a then 'B' else 'A' end as choice, true as ok
from (select sample_id, token_idx, {BEST.format(ids=IDS_A)} as a, {BEST.format(ids=IDS_B)} as b from T)""", **T),
)
def v02(spark, d):
    a = v.best_logit(F.col("logits"), F.array(F.col("token_id"), F.col("token_id") + 7, F.lit(70), F.lit(-1)))
    b = v.best_logit(F.col("logits"), F.array(F.col("token_id") + 20, F.col("token_id") + 33))
    return rounded(fx.tokens(spark, d).select(*KEY, v.p_true(a, b).alias("s")).select(*KEY, "s.*"))


LOGP = "case when token_idx = 3 then -100.0 else logits[token_id + 1] - nz end"


@query("v03_sequence_likelihood", cte(f"select sample_id, {rd(f'exp(avg(ln(least(greatest(exp({LOGP}), 1e-12), 1.0))))')} as confidence from TN group by sample_id", **TP))
def v03(spark, d):
    lp = F.when(F.col("token_idx") != 3, v.element(v.log_softmax(F.col("logits")), F.col("token_id")))
    return rounded(cf.sequence_likelihood(fx.tokens(spark, d).select("sample_id", lp.alias("logprob")), ["sample_id"]))


PROMPTS = """select cast(floor(event_id / 5) as bigint) as sample_id, event_id % 5 as q_idx, value / 100.0::double as c, event_id % 13 <> 0 as ok from events"""


def prompts(spark, d):
    return fx.table(spark, d, "events").select(
        F.expr("event_id div 5").alias("sample_id"), (F.col("event_id") % 5).alias("q_idx"),
        (F.col("value") / 100.0).alias("c"), (F.col("event_id") % 13 != 0).alias("ok"),
    )


def _ensemble_sql(agg, extra=""):
    return cte(
        f"""select sample_id, {rd(agg)} as confidence, {rd('max(case when q_idx = 0 then c end)')} as original_confidence, count(*) as num_prompts_used,
  {rd('list_sum(list_transform(list(c order by q_idx), lambda e, i: e * i))')} as list_check
from Q where ok {extra} group by sample_id having max(case when q_idx = 0 then c end) is not null""", Q=PROMPTS)


def _ensemble(spark, d, how, first_n=None):
    out = cf.ensemble(prompts(spark, d), ["sample_id"], how, first_n)
    return rounded(out.withColumn("list_check", place_sum("all_confidences")).drop("all_confidences"))


@query("v04_prompt_ensemble", _ensemble_sql("avg(c)"))
def v04(spark, d):
    return _ensemble(spark, d, "mean")


@query("v04_prompt_ensemble_median", _ensemble_sql("quantile_cont(c, 0.5)", "and q_idx <= 3"))
def v04_median(spark, d):
    return _ensemble(spark, d, "median", 3)


@query("v05_sigmoid", f"select event_id, {rd('1.0 / (1.0 + exp(-(value / 50.0 - 1.0)))')} as c from events")
def v05(spark, d):
    return rounded(fx.table(spark, d, "events").select("event_id", v.sigmoid(F.col("value") / 50.0 - 1.0).alias("c")))


LINEAR = [((i * 5) % 11 - 5) / 10.0 for i in range(64)]
H1 = np.array([[((i * (k + 1)) % 7 - 3) / 4.0 for i in range(64)] for k in range(4)])


@query(
    "v06_probe_score",
    f"""select vec_id, {rd("1.0 / (1.0 + exp(-(0.1 + list_sum(list_transform(cast(embedding as double[]), lambda x, i: x * (((i - 1) * 5) % 11 - 5) / 10.0)))))")} as c from embeddings""",
)
def v06(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("h"))
    return rounded(emb.select("vec_id", v.sigmoid(cf.linear_score(F.col("h"), LINEAR, 0.1)).alias("c")))


@query(
    "v06_probe_score_hidden",
    f"""select vec_id, {rd('''1.0 / (1.0 + exp(-(-0.2 + list_sum(list_transform(range(4), lambda k:
  (k - 1.5) * greatest(0.0, k / 10.0 + list_sum(list_transform(cast(embedding as double[]), lambda x, i: x * (((i - 1) * (k + 1)) % 7 - 3) / 4.0))))))))''')} as c from embeddings""",
)
def v06_hidden(spark, d):
    layers = [(H1, np.arange(4) / 10.0), (np.array([[k - 1.5 for k in range(4)]]), np.array([-0.2]))]
    emb = fx.table(spark, d, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("h"))
    return rounded(cf.mlp_score(emb, "h", layers, "c").select("vec_id", "c"))


@query("v07_run_average", cte(f"select method, vlm, sample_id, {rd('avg(c)')} as confidence, count(*) as n_runs from P group by method, vlm, sample_id", P=fx.P_SQL))
def v07(spark, d):
    return rounded(cf.run_average(fx.predictions(spark, d), ["method", "vlm", "sample_id"]))


def samples(spark, d):
    """[T, D] states of a sample: its eight token vectors in order."""
    step = F.struct("token_idx", "logits")
    return fx.tokens(spark, d).groupBy("sample_id").agg(
        F.transform(F.sort_array(F.collect_list(step)), lambda s: s["logits"]).alias("states")
    )


SAMPLES = "select sample_id, list(logits order by token_idx) as states from T group by sample_id"


@query(
    "v08_token_vector",
    cte(f"select sample_id, {rd(wsum('states[1]'))} as first_v, {rd(wsum('states[-1]'))} as last_v from S", **T, S=SAMPLES),
)
def v08(spark, d):
    st = F.col("states")
    return rounded(samples(spark, d).select(
        "sample_id", place_sum(v.token_vector(st, "first")).alias("first_v"), place_sum(v.token_vector(st, "last")).alias("last_v")
    ))


@query(
    "v09_last_unmasked",
    cte("""select sample_id, token_idx, cast(case when mask[pos + 1] = 0 then coalesce(list_max(list_filter(list_transform(mask, lambda m, i: case when m = 1 then i - 1 end), lambda i: i is not null)), pos) else pos end as int) as position
from (select sample_id, token_idx, 20 + token_id as pos, list_transform(logits, lambda x, i: case when x > 0.1 and i < 40 then 1 else 0 end) as mask from T)""", **T),
)
def v09(spark, d):
    mask = F.transform(F.col("logits"), lambda x, i: F.when((x > 0.1) & (i < 39), 1).otherwise(0))
    shaped = fx.tokens(spark, d).select(*KEY, (F.col("token_id") + 20).alias("pos"), mask.alias("mask"))
    return shaped.select(*KEY, v.last_unmasked(F.col("mask"), F.col("pos")).cast("int").alias("position"))


@query(
    "v10_layer_concat",
    cte(f"""select sample_id, cast(len(x) as int) as n, {rd(wsum('x'))} as s from (
  select sample_id, case when len(states) - 1 >= 5 then list_concat(states[-1], states[-6]) when len(states) - 1 >= 2 then list_concat(states[-1], states[-2]) else states[-1] end as x from S)""", **T, S=SAMPLES),
)
def v10(spark, d):
    x = v.concat_layers(F.col("states"), [0, 5])
    return rounded(samples(spark, d).select("sample_id", x.alias("x")).select("sample_id", F.size("x").alias("n"), place_sum("x").alias("s")))


@query(
    "v11_state_stack",
    cte(f"""select sample_id, {rd(wsum('''flatten(flatten(list_transform(range(cast(len(states) as bigint)), lambda l: list_transform(range(64), lambda i: [states[l + 1][i + 1], -states[l + 1][i + 1], states[l + 1][i + 1] * 2]))))'''))} as s, cast(len(states) * 192 as int) as n from S""", **T, S=SAMPLES),
)
def v11(spark, d):
    st = F.col("states")

    def times(k):
        return F.transform(st, lambda layer: F.transform(layer, lambda x: x * k))

    stacked = v.stack_states(st, times(-1.0), times(2.0), "all")
    flat = samples(spark, d).select("sample_id", F.flatten(F.flatten(stacked)).alias("x"))
    return rounded(flat.select("sample_id", place_sum("x").alias("s"), F.size("x").alias("n")))


@query(
    "v12_logit_stats",
    cte(f"""select sample_id, token_idx, {rd('logits[token_id + 1] - nz')} as log_prob_actual, {rd('exp(logits[token_id + 1] - nz)')} as prob_actual, {rd('logits[token_id + 1]')} as logit_actual,
  {rd('exp(list_max(logits) - nz)')} as prob_argmax, {rd('list_max(logits)')} as logit_argmax, cast(list_position(logits, list_max(logits)) - 1 = token_id as int) as actual_is_argmax from TN""", **TP),
)
def v12(spark, d):
    return rounded(fx.tokens(spark, d).select(*KEY, v.logit_stats(F.col("logits"), F.col("token_id")).alias("s")).select(*KEY, "s.*"))


@query("v13_entropy", cte(f"select sample_id, token_idx, {rd('-list_sum(list_transform(p, lambda x: x * ln(x + 1e-9)))')} as entropy from TQ", **TP))
def v13(spark, d):
    return rounded(fx.tokens(spark, d).select(*KEY, v.entropy(v.softmax(F.col("logits"))).alias("entropy")))


@query("v14_margins", cte(f"select sample_id, token_idx, {rd('a[1] - a[2]')} as logit_margin, {rd('b[1] - b[2]')} as prob_margin from (select sample_id, token_idx, list_reverse_sort(logits) as a, list_reverse_sort(p) as b from TQ)", **TP))
def v14(spark, d):
    return rounded(fx.tokens(spark, d).select(*KEY, v.margin(F.col("logits")).alias("logit_margin"), v.margin(v.softmax(F.col("logits"))).alias("prob_margin")))


@query("v15_norm_and_spread", cte(f"select sample_id, token_idx, {rd(norm('logits'))} as l2, {rd('list_stddev_samp(logits)')} as std from T", **T))
def v15(spark, d):
    return rounded(fx.tokens(spark, d).select(*KEY, v.l2(F.col("logits")).alias("l2"), v.std_sample(F.col("logits")).alias("std")))


# hidden states with logits from the prototype matrix, the token gradient, and five perturbation steps
PROTO = {
    "W": fx.W_SQL,
    "WL": 'select list(w order by "row") as w from W',
    "H": "select vec_id, label as token_id, cast(embedding as double[]) as h from embeddings",
    "HZ": "select vec_id, token_id, h, w, list_transform(w, lambda r: list_inner_product(r, h)) as z from H cross join WL",
    "HN": f"select *, {lse('z')} as n0 from HZ",
    "HP": "select *, list_transform(z, lambda e: exp(e - n0)) as p0 from HN",
    "HG": "select *, list_transform(range(64), lambda i: list_sum(list_transform(p0, lambda q, k: q * w[k][i + 1])) - w[token_id + 1][i + 1]) as g from HP",
}
STEPS = {
    **PROTO,
    "HK": f"""select *, list_transform(h, lambda x, i: x + k * 4.0 * (g[i] / gn)) as hk from (
  select *, {norm('g')} as gn from HG) cross join (select unnest(range(1, 6)) as k)""",
    "KZ": "select *, list_transform(w, lambda r: list_inner_product(r, hk)) as zk from HK",
    "KN": f"select *, {lse('zk')} as nk from KZ",
    "KP": "select *, list_transform(zk, lambda e: exp(e - nk)) as pk, list_position(z, list_max(z)) as a0, list_position(zk, list_max(zk)) as ak, list_reverse_sort(zk) as sk from KN",
}


def hidden(spark, d):
    return fx.table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("token_id"), v.doubles(F.col("embedding")).alias("h")
    )


def _with_gradient(spark, d):
    return tr.gradient(hidden(spark, d), fx.prototypes(spark, d), ["vec_id"])


@query("v16_gradient", cte(f"select vec_id, {rd(norm('g'))} as norm, {rd(wsum('g'))} as s from HG", **PROTO))
def v16(spark, d):
    out = _with_gradient(spark, d)
    return rounded(out.select("vec_id", v.l2(F.col("g")).alias("norm"), place_sum("g").alias("s")))


@query("v16_gradient_sliced", cte(f"select vec_id, {rd(norm('g'))} as norm, {rd(wsum('g'))} as s from HG", **PROTO))
def v16_sliced(spark, d):
    out = tr.gradient(hidden(spark, d), fx.prototypes(spark, d), ["vec_id"], tile_rows=4)
    return rounded(out.select("vec_id", v.l2(F.col("g")).alias("norm"), place_sum("g").alias("s")))


@query("v17_trajectory", cte(f"select vec_id, cast(k as int) as step, {rd(wsum('hk'), 6)} as s from HK", **STEPS))
def v17(spark, d):
    return rounded(tr.trajectory(_with_gradient(spark, d)).select("vec_id", "step", place_sum("h_k").alias("s")), 6)


@query("v18_projection", cte(f"select vec_id, cast(k as int) as step, {rd(wsum('zk'))} as s, {rd('list_max(zk)')} as best from KZ", **STEPS))
def v18(spark, d):
    moved = tr.trajectory(_with_gradient(spark, d)).select("vec_id", "step", "h_k")
    logits = tr.project(moved, fx.prototypes(spark, d), ["vec_id", "step"], vec="h_k", out="logits_k")
    return rounded(logits.select("vec_id", "step", place_sum("logits_k").alias("s"), F.array_max("logits_k").alias("best")))


MEASURES = {
    "perturbed_log_prob_actual": "zk[token_id + 1] - nk",
    "perturbed_prob_actual": "exp(zk[token_id + 1] - nk)",
    "perturbed_logit_actual": "zk[token_id + 1]",
    "delta_log_prob_actual_from_original": "(z[token_id + 1] - n0) - (zk[token_id + 1] - nk)",
    "perturbed_prob_argmax": "exp(list_max(zk) - nk)",
    "perturbed_logit_argmax": "list_max(zk)",
    "did_argmax_change_from_original": "cast(a0 <> ak as double)",
    "perturbed_entropy": "-list_sum(list_transform(pk, lambda x: x * ln(x + 1e-9)))",
    "perturbed_margin_logit_top1_top2": "sk[1] - sk[2]",
    "perturbed_norm_logits_L2": norm("zk"),
    "kl_div_perturbed_from_original": "list_sum(list_transform(p0, lambda x, i: x * (ln(x) - ln(pk[i]))))",
    "js_div_perturbed_from_original": """0.5 * list_sum(list_transform(p0, lambda x, i: (x + pk[i]) / 2 * (ln((x + pk[i]) / 2) - ln(x))))
  + 0.5 * list_sum(list_transform(p0, lambda x, i: (x + pk[i]) / 2 * (ln((x + pk[i]) / 2) - ln(pk[i]))))""",
    "cosine_sim_logits_perturbed_to_original": f"list_inner_product(z, zk) / ({norm('z')} * {norm('zk')})",
    "cosine_sim_hidden_perturbed_to_original": f"list_inner_product(h, hk) / ({norm('h')} * {norm('hk')})",
    "l2_dist_hidden_perturbed_from_original": "sqrt(list_sum(list_transform(h, lambda x, i: pow(hk[i] - x, 2))))",
}
STEP_SQL = {**STEPS, "M": "select vec_id, token_id, k, " + ", ".join(f"{e} as {m}" for m, e in MEASURES.items()) + " from KP"}


def _measures(spark, d):
    return tr.step_measures(hidden(spark, d), fx.prototypes(spark, d), ["vec_id"])


@query("v19_radius_to_flip", cte("select vec_id, coalesce(min(case when did_argmax_change_from_original = 1 then k end) * 4.0, cast('inf' as double)) as epsilon_to_flip_token from M group by vec_id", **STEP_SQL))
def v19(spark, d):
    return tr.radius_to_flip(_measures(spark, d), ["vec_id"])


ENERGY = "sum(greatest(0.0, delta_log_prob_actual_from_original) * case when k = 5 then 0.5 else 1.0 end) / 5.0"


@query("v20_perturbation_energy", cte(f"select vec_id, {rd(ENERGY)} as pei_value_token from M group by vec_id", **STEP_SQL))
def v20(spark, d):
    return rounded(tr.perturbation_energy(_measures(spark, d), ["vec_id"]))


STATS = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
ALL_STATS = ", ".join(f"{rd(f'{STATS[s]}({m})', 7)} as {m}_{s}" for m in tr.STEP_MEASURES for s in tr.STATISTICS)


@query("v21_trajectory_statistics", cte(f"select vec_id, {ALL_STATS} from M group by vec_id", **STEP_SQL))
def v21(spark, d):
    return rounded(tr.trajectory_statistics(_measures(spark, d), ["vec_id"]), 7)


STATE_SQL = {
    "original_log_prob_actual": "z[token_id + 1] - n0",
    "original_prob_actual": "exp(z[token_id + 1] - n0)",
    "original_logit_actual": "z[token_id + 1]",
    "original_prob_argmax": "exp(list_max(z) - n0)",
    "original_logit_argmax": "list_max(z)",
    "original_entropy": "-list_sum(list_transform(p0, lambda x: x * ln(x + 1e-9)))",
    "original_margin_logit_top1_top2": "list_reverse_sort(z)[1] - list_reverse_sort(z)[2]",
    "original_margin_prob_top1_top2": "list_reverse_sort(p0)[1] - list_reverse_sort(p0)[2]",
    "original_norm_logits_L2": norm("z"),
    "original_std_logits": "list_stddev_samp(z)",
    "original_norm_hidden_state_L2": norm("h"),
    "is_actual_token_original_argmax": "cast(list_position(z, list_max(z)) - 1 = token_id as double)",
    "jacobian_norm_token": norm("g"),
}


@query(
    "v21_token_features",
    cte(
        "select vec_id, token_id, " + ", ".join(f"{rd(e, 7)} as {m}" for m, e in STATE_SQL.items())
        + ", epsilon_to_flip_token, pei_value_token, " + ", ".join(f"{m}_{s}" for m in tr.STEP_MEASURES for s in tr.STATISTICS)
        + f""" from HG join (select vec_id, {rd(ENERGY, 7)} as pei_value_token, coalesce(min(case when did_argmax_change_from_original = 1 then k end) * 4.0, cast('inf' as double)) as epsilon_to_flip_token, {ALL_STATS} from M group by vec_id) using (vec_id)""",
        **STEP_SQL,
    ),
)
def v21_all(spark, d):
    return rounded(tr.trajectory_features(hidden(spark, d), fx.prototypes(spark, d), ["vec_id"]), 7)


@query("v21_token_features_sliced", ORACLES["v21_token_features"])
def v21_sliced(spark, d):
    out = tr.trajectory_features(hidden(spark, d), fx.prototypes(spark, d), ["vec_id"], tile_rows=4)
    return rounded(out, 7)


NEXT = {**TP, "Q2": "select a.sample_id, a.token_idx, a.p as p, b.p as q, a.logits as x, b.logits as y from TQ a join TQ b on a.sample_id = b.sample_id and b.token_idx = a.token_idx + 1"}


def neighbours(spark, d):
    cur = fx.tokens(spark, d).select(*KEY, F.col("logits").alias("x"), v.softmax(F.col("logits")).alias("p"))
    nxt = cur.select("sample_id", (F.col("token_idx") - 1).alias("token_idx"), F.col("x").alias("y"), F.col("p").alias("q"))
    return cur.join(nxt, KEY)


@query("v22_kl", cte(f"select sample_id, token_idx, {rd('list_sum(list_transform(p, lambda a, i: a * (ln(a) - ln(q[i]))))')} as kl from Q2", **NEXT))
def v22(spark, d):
    return rounded(neighbours(spark, d).select(*KEY, v.kl(F.col("p"), F.col("q")).alias("kl")))


@query(
    "v23_js",
    cte(f"""select sample_id, token_idx,
  {rd('0.5 * list_sum(list_transform(p, lambda a, i: (a + q[i]) / 2 * (2 * ln((a + q[i]) / 2) - ln(a) - ln(q[i]))))')} as js_reversed,
  {rd('0.5 * list_sum(list_transform(p, lambda a, i: a * (ln(a) - ln((a + q[i]) / 2)) + q[i] * (ln(q[i]) - ln((a + q[i]) / 2))))')} as js from Q2""", **NEXT),
)
def v23(spark, d):
    p, q = F.col("p"), F.col("q")
    return rounded(neighbours(spark, d).select(*KEY, v.js_reversed(p, q).alias("js_reversed"), v.js(p, q).alias("js")))


@query(
    "v24_cosine_and_distance",
    cte(f"""select sample_id, token_idx, {rd(f"list_inner_product(x, y) / ({norm('x')} * {norm('y')})")} as cos,
  {rd(f"list_inner_product(x, y) / ({norm('x')} * {norm('y')} + 1e-12)")} as view_cos, {rd('sqrt(list_sum(list_transform(x, lambda a, i: pow(a - y[i], 2))))')} as dist from Q2""", **NEXT),
)
def v24(spark, d):
    x, y = F.col("x"), F.col("y")
    return rounded(neighbours(spark, d).select(*KEY, v.cosine(x, y).alias("cos"), v.view_cosine(x, y).alias("view_cos"), v.l2_distance(x, y).alias("dist")))


VIEWS = {
    "V": fx.VIEWS_SQL,
    "VN": f"select *, {lse('h_base')} as nb, {lse('h_blank')} as nk, list_position(h_base, list_max(h_base)) as tb, list_position(h_blank, list_max(h_blank)) as tk from V",
}


@query(
    "v25_view_diagnostics",
    cte(f"""select sample_id, 'blank' as view, case when mask = 1 then {rd(f"list_inner_product(h_base, h_blank) / ({norm('h_base')} * {norm('h_blank')} + 1e-12)")} else cast('nan' as double) end as cos_base,
  case when mask = 1 then {rd('abs(exp(h_base[tb] - nb) - exp(h_blank[tb] - nk))')} else cast('nan' as double) end as dp,
  cast(case when mask = 1 then case when tb <> tk then 1 else 0 end else -1 end as int) as flip from VN""", **VIEWS),
)
def v25(spark, d):
    pairs = fx.views(spark, d).withColumns({"tb": v.argmax(F.col("h_base")), "tk": v.argmax(F.col("h_blank"))})
    base = pairs.select("sample_id", F.col("h_base").alias("h"), F.array_max(v.softmax(F.col("h_base"))).alias("p_top1"), F.col("tb").alias("top1"))
    blank = pairs.select(
        "sample_id", F.lit("blank").alias("view"), F.col("h_blank").alias("h"),
        v.element(v.softmax(F.col("h_blank")), F.col("tb")).alias("p_of_base"), F.col("tk").alias("top1"), "mask",
    )
    return rounded(cf.view_diagnostics(base, blank))


@query("v26_storage_type", "select vec_id, case when n > 0 then 'float32' else 'float16' end as dtype, n as overflow from (select vec_id, cast(len(list_filter(cast(embedding as double[]), lambda x: abs(x * 200000) > 60000)) as int) as n from embeddings)")
def v26(spark, d):
    scaled = F.transform(v.doubles(F.col("embedding")), lambda x: x * 200000)
    return fx.table(spark, d, "embeddings").select("vec_id", v.storage_type(scaled).alias("s")).select("vec_id", "s.*")


HEADS = "select sample_id, token_idx // 4 as layer, token_idx % 4 as head, i as pos, abs(logits[i + 1]) as a from T, (select unnest(range(64)) as i)"


def heads(spark, d):
    return fx.tokens(spark, d).select(
        "sample_id", F.expr("token_idx div 4").alias("layer"), (F.col("token_idx") % 4).alias("head"),
        F.transform(F.col("logits"), lambda x: F.abs(x)).alias("weights"),
    )


def _attention_sql(inner):
    return cte(f"select sample_id, pos, {rd('a / sum(a) over (partition by sample_id)')} as a from ({inner})", **T, A=HEADS)


def _attention(spark, d, how):
    out = cf.aggregate_attention(heads(spark, d), ["sample_id"], how)
    return rounded(out.select("sample_id", F.posexplode("attention").alias("pos", "a")).withColumn("pos", F.col("pos").cast("bigint")))


@query("v27_attention_mean", _attention_sql("select sample_id, pos, avg(a) as a from (select sample_id, layer, pos, avg(a) as a from A group by all) group by all"))
def v27(spark, d):
    return _attention(spark, d, "mean")


@query("v27_attention_max", _attention_sql("select sample_id, pos, max(a) as a from A group by all"))
def v27_max(spark, d):
    return _attention(spark, d, "max")


@query("v27_attention_last_layer", _attention_sql("select sample_id, pos, avg(a) as a from A join (select sample_id, max(layer) as layer from A group by all) using (sample_id, layer) group by all"))
def v27_last(spark, d):
    return _attention(spark, d, "last_layer")


def _region(lo, hi):
    return f"coalesce(list_sum(list_filter(a, lambda x, i: i > {lo} and i <= {hi})), 0.0)"


_REGIONS = {"other": ("0", "vs"), "vision": ("vs", "ve"), "text": ("ve", "te"), "generated": ("te", "64")}


@query(
    "v28_attention_regions",
    cte(
        "select sample_id, token_idx, " + ", ".join(f"{rd(_region(*r))} as total_to_{k}" for k, r in _REGIONS.items()) + ", "
        + ", ".join(f"{rd(_region(*r) + ' / list_sum(a)')} as pct_to_{k}" for k, r in _REGIONS.items())
        + f""", {rd('-list_sum(list_transform(a, lambda x: x * ln(x + 1e-9)))')} as entropy, cast(list_position(a, list_max(a)) - 1 as int) as max_position, {rd('list_max(a)')} as max_value
from (select sample_id, token_idx, list_transform(logits, lambda x: abs(x)) as a, 4 + token_id as vs, 20 + token_id as ve, 50 + token_id * 2 as te from T)""",
        **T,
    ),
)
def v28(spark, d):
    a = F.transform(F.col("logits"), lambda x: F.abs(x))
    stats = v.region_stats(F.col("a"), F.col("token_id") + 4, F.col("token_id") + 20, F.col("token_id") * 2 + 50)
    return rounded(fx.tokens(spark, d).withColumn("a", a).select(*KEY, stats.alias("s")).select(*KEY, "s.*"))


IDS = "select sample_id, token_idx, list_transform(logits, lambda x: cast(floor(abs(x) * 100) as int) % 23) as ids from T"


def ids(spark, d):
    return fx.tokens(spark, d).select(*KEY, F.transform(F.col("logits"), lambda x: F.floor(F.abs(x) * 100).cast("int") % 23).alias("ids"))


def _span_sql(stop):
    return cte(
        f"""select sample_id, token_idx, b as vision_start, e as vision_end, e as text_start, 64 as text_end, e - b as num_vision, 64 - e as num_text, b as num_other from (
  select sample_id, token_idx, cast(case when f is null then 0 else f - 1 end as int) as b, cast(case when f is null then 0 else {stop} end as int) as e
  from (select *, list_position(ids, 11) as f from I))""", **T, I=IDS)


@query("v29_marker_span_ends", _span_sql("65 - list_position(list_reverse(ids), 11)"))
def v29(spark, d):
    return ids(spark, d).select(*KEY, v.marker_span(F.col("ids"), "between_ends", F.lit(11)).alias("s")).select(*KEY, "s.*")


@query("v29_marker_span_pair", _span_sql("list_min(list_filter(list_transform(ids, lambda x, i: case when x = 7 and i > f then i end), lambda i: i is not null))"))
def v29_pair(spark, d):
    return ids(spark, d).select(*KEY, v.marker_span(F.col("ids"), "start_to_end", F.lit(11), F.lit(7)).alias("s")).select(*KEY, "s.*")


def uniform_sql(salt):
    return f"((cast(concat('0x', substr(md5(concat_ws('_', cast(vec_id as varchar), cast(i - 1 as varchar), '{salt}')), 1, 12)) as bigint) + 0.5) / 281474976710656.0)"


E = "select vec_id, cast(embedding as double[]) as h from embeddings"


def emb(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("h"))


@query(
    "v30_null_views",
    cte(f"""select vec_id, {rd(wsum('list_transform(h, lambda x, i: 1.0)'))} as constant, {rd(wsum(f"list_transform(h, lambda x, i: {uniform_sql('null')})"))} as uniform_noise,
  {rd(wsum('list_transform(h, lambda x, i: list_avg(h[greatest(i - 2, 1):i + 2]))'))} as smoothed,
  {rd(wsum(f"list_transform(list_sort(list_transform(h, lambda x, i: {{'u': {uniform_sql('null')}, 'x': x}})), lambda s: s.x)"))} as shuffled from E""", E=E),
)
def v30(spark, d):
    h, key = F.col("h"), F.col("vec_id")
    kinds = ["constant", "uniform_noise", "smoothed", "shuffled"]
    made = emb(spark, d).select("vec_id", *[v.null_view(h, key, k, radius=2).alias(k) for k in kinds])
    return rounded(made.select("vec_id", *[place_sum(k).alias(k) for k in kinds]))


GAUSS = f"sqrt(-2.0 * ln({uniform_sql('noiseu')})) * cos(6.283185307179586 * {uniform_sql('noisev')})"


@query("v31_noise_view", cte(f"select vec_id, {rd(wsum(f'list_transform(h, lambda x, i: least(greatest(x + 0.1 * {GAUSS}, 0.0), 1.0))'))} as s from E", E=E))
def v31(spark, d):
    return rounded(emb(spark, d).select("vec_id", place_sum(v.noise_view(F.col("h"), F.col("vec_id"))).alias("s")))


# token features: an infinite flip radius on every third token, another infinity, and a plain value
FEATS = ["epsilon_to_flip_token", "ratio", "margin"]
FEAT_SQL = """select sample_id as hash_id, token_idx, token_id, cast(sample_id % 2 = 0 as int) as is_correct,
  case when token_idx % 3 = 0 then cast('inf' as double) else token_id * 2.0::double end as epsilon_to_flip_token,
  case when token_idx % 4 = 1 then cast('-inf' as double) when token_idx % 4 = 2 then cast('nan' as double) else logits[1] end as ratio, logits[2] as margin from T"""
CLEAN = "select hash_id, token_idx, token_id, is_correct, case when isinf(epsilon_to_flip_token) then 20.0 else epsilon_to_flip_token end as epsilon_to_flip_token, case when isfinite(ratio) then ratio else 0.0 end as ratio, margin from F"


def feats(spark, d):
    i = F.col("token_idx")
    return fx.tokens(spark, d).select(
        F.col("sample_id").alias("hash_id"), "token_idx", "token_id", (F.col("sample_id") % 2 == 0).cast("int").alias("is_correct"),
        F.when(i % 3 == 0, F.lit(float("inf"))).otherwise(F.col("token_id") * 2.0).alias("epsilon_to_flip_token"),
        F.when(i % 4 == 1, F.lit(float("-inf"))).when(i % 4 == 2, F.lit(float("nan"))).otherwise(F.col("logits")[0]).alias("ratio"),
        F.col("logits")[1].alias("margin"),
    )


@query(
    "t01_sequences",
    cte(f"""select hash_id, cast(count(*) as int) as seq_length, cast(arg_min(is_correct, token_idx) as int) as label, {rd('list_sum(list_transform(flatten(list([epsilon_to_flip_token, ratio, margin] order by token_idx)), lambda e, i: e * i))')} as s
from C group by hash_id""", **T, F=FEAT_SQL, C=CLEAN),
)
def t01(spark, d):
    seq = sq.sequences(feats(spark, d), FEATS)
    return rounded(seq.select("hash_id", "seq_length", "label", place_sum(F.flatten("features")).alias("s")))


@query(
    "t02_scaler",
    cte("select hash_id, token_idx, " + ", ".join(
        f"{rd(f'({f} - (select avg({f}) from C)) / (select case when stddev_pop({f}) > 0 then stddev_pop({f}) else 1.0 end from C)')} as {f}" for f in FEATS)
        + " from C", **T, F=FEAT_SQL, C=CLEAN),
)
def t02(spark, d):
    rows = sq.clean_features(feats(spark, d), FEATS)
    return rounded(sq.apply_scaler(rows, sq.fit_scaler(rows, FEATS), FEATS).select("hash_id", "token_idx", *FEATS))


@query(
    "t03_pad",
    cte(f"""select hash_id, cast(any_value(total) as int) as seq_length, cast(5 * 3 as int) as n, {rd('list_sum(list_transform(flatten(list([epsilon_to_flip_token, ratio, margin] order by token_idx)), lambda e, i: e * i))')} as s
from (select *, row_number() over (partition by hash_id order by token_idx) as k, count(*) over (partition by hash_id) as total from C) where k <= 5 group by hash_id""", **T, F=FEAT_SQL, C=CLEAN),
)
def t03(spark, d):
    padded = sq.padded_sequences(feats(spark, d), FEATS, 5).select("hash_id", "seq_length", F.flatten("features").alias("x"))
    return rounded(padded.select("hash_id", "seq_length", F.size("x").alias("n"), place_sum("x").alias("s")))


@query(
    "t04_token_rows",
    cte("select sample_id, cast(row_number() over (partition by sample_id order by token_idx) - 1 as int) as token_idx, token_id, concat('t', token_id) as token_str from T", **T),
)
def t04(spark, d):
    return sq.token_rows(_packed(spark, d), []).select("sample_id", "token_idx", "token_id", "token_str")


def _packed(spark, d):
    token = F.struct("token_idx", "token_id", F.concat(F.lit("t"), "token_id").alias("token_str"), F.col("logits")[0].alias("margin"))
    return fx.tokens(spark, d).groupBy("sample_id").agg(F.sort_array(F.collect_list(token)).alias("tokens"))


@query(
    "s09_token_features",
    cte(f"select sample_id, cast(row_number() over (partition by sample_id order by token_idx) - 1 as int) as token_idx, token_id, {rd('logits[1]')} as margin, cast('nan' as double) as absent from T", **T),
)
def s09(spark, d):
    return rounded(sq.token_rows(_packed(spark, d), ["margin", "absent"]).select("sample_id", "token_idx", "token_id", "margin", "absent"))
