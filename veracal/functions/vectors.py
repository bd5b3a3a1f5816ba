"""Expressions over array columns: logits, hidden vectors, masks, id sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, also where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_distance(a: Column, b: Column) -> Column:
    return l2(F.zip_with(a, b, lambda x, y: x - y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with each norm floored at 1e-8."""
    floor = F.lit(1e-8)
    return dot(a, b) / (F.greatest(l2(a), floor) * F.greatest(l2(b), floor))


def view_cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-12 added below; NaN when either vector is zero."""
    norms = l2(a) * l2(b)
    return F.when(norms > 0, dot(a, b) / (norms + F.lit(1e-12))).otherwise(F.lit(float("nan")))


def element(v: Column, index: Column) -> Column:
    """Element at a zero-based position, null outside the array."""
    return F.when((index >= 0) & (index < F.size(v)), F.element_at(v, (index + 1).cast("int")))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def log_sum_exp(v: Column) -> Column:
    return let(
        F.array_max(v),
        lambda peak: peak + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))),
    )


def softmax(v: Column) -> Column:
    return let(log_sum_exp(v), lambda norm: F.transform(v, lambda x: F.exp(x - norm)))


def log_softmax(v: Column) -> Column:
    return let(log_sum_exp(v), lambda norm: F.transform(v, lambda x: x - norm))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * F.log(x + F.lit(EPS)))


def top_k(v: Column, k: int) -> Column:
    """array of struct(value, index), value descending, index ascending on ties.

    One walk keeps the best ``k`` so far; only an element that enters them costs more than a comparison.
    """
    placed = F.transform(v, lambda x, i: F.struct((-x).cast("double").alias("neg"), i.alias("index")))
    none = F.array().cast("array<struct<neg:double,index:int>>")

    def keep(held: Column, s: Column) -> Column:
        enters = (F.size(held) < k) | (s < F.get(held, F.lit(k - 1)))
        return F.when(enters, F.slice(F.array_sort(F.array_append(held, s)), 1, k)).otherwise(held)

    return F.transform(
        F.aggregate(placed, none, keep), lambda s: F.struct((-s["neg"]).alias("value"), s["index"].alias("index"))
    )


def margin(v: Column) -> Column:
    """Gap between the two largest elements, found in one walk; null elements are passed over, null below two others."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("second"))

    def keep(held: Column, x: Column) -> Column:
        first, second = held["first"], held["second"]
        return (
            F.when(x.isNull(), held)
            .when(first.isNull() | (x > first), F.struct(x.cast("double").alias("first"), first.alias("second")))
            .when(second.isNull() | (x > second), F.struct(first.alias("first"), x.cast("double").alias("second")))
            .otherwise(held)
        )

    return F.aggregate(v, start, keep, lambda held: held["first"] - held["second"])


def std_sample(v: Column) -> Column:
    n = F.size(v)
    squares = let(
        total(v) / n,
        lambda mean: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)),
    )
    return F.sqrt(squares / F.when(n > 1, n - 1))


def kl(p: Column, q: Column) -> Column:
    """Sum of p * (log p - log q); empty cells of p add nothing."""
    terms = F.zip_with(
        p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(y))).otherwise(F.lit(0.0))
    )
    return total(terms)


def midpoint(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: (x + y) * 0.5)


def js_reversed(p: Column, q: Column) -> Column:
    """Half the divergences from the midpoint to each side (the form the features use)."""
    m = midpoint(p, q)
    return kl(m, p) * 0.5 + kl(m, q) * 0.5


def js(p: Column, q: Column) -> Column:
    """Standard Jensen-Shannon divergence."""
    m = midpoint(p, q)
    return kl(p, m) * 0.5 + kl(q, m) * 0.5


def logit_stats(v: Column, token: Column) -> Column:
    """Log-probability, probability and logit of a token and of the argmax."""
    best = F.array_max(v)
    chosen = element(v, token)
    return let(
        log_sum_exp(v),
        lambda norm: F.struct(
            (chosen - norm).alias("log_prob_actual"),
            F.exp(chosen - norm).alias("prob_actual"),
            chosen.alias("logit_actual"),
            F.exp(best - norm).alias("prob_argmax"),
            best.alias("logit_argmax"),
            (argmax(v) == token).cast("int").alias("actual_is_argmax"),
        ),
    )


def best_logit(v: Column, ids: Column) -> Column:
    """Largest logit over the given token ids; ids out of range are ignored."""
    valid = F.filter(ids, lambda i: (i >= 0) & (i < F.size(v)))
    picked = F.transform(valid, lambda i: F.element_at(v, (i + 1).cast("int")))
    return F.coalesce(F.array_max(picked), F.lit(float("-inf")))


def p_true(a: Column, b: Column) -> Column:
    """struct(p_true, choice, ok) from the logits of "no" (a) and "yes" (b)."""
    missing = (a == F.lit(float("-inf"))) | (b == F.lit(float("-inf")))
    return F.struct(
        F.when(~missing, 1.0 / (1.0 + F.exp(a - b))).alias("p_true"),
        F.when(~missing, F.when(b > a, F.lit("B")).otherwise(F.lit("A"))).alias("choice"),
        (~missing).alias("ok"),
    )


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def token_vector(states: Column, which: str) -> Column:
    """First or last vector of a [T, D] array."""
    return F.try_element_at(states, F.lit(1 if which == "first" else -1))


def last_unmasked(mask: Column, position: Column) -> Column:
    """The position itself, or the last unmasked one when it is masked."""
    open_positions = F.filter(
        F.transform(mask, lambda m, i: F.when(m != 0, i)), lambda i: i.isNotNull()
    )
    masked = element(mask, position) == 0
    return F.when(masked, F.coalesce(F.array_max(open_positions), position)).otherwise(position)


def concat_layers(states: Column, offsets: list[int]) -> Column:
    """Vectors of the layers counted from the last one (offset 0), joined in the given order.

    A row with too few layers gives its last two, or the only one.
    """
    n = F.size(states) - 1

    def back(offset: int) -> Column:
        return F.try_element_at(states, F.lit(-1 - offset))

    return (
        F.when(n >= max(offsets), F.concat(*[back(o) for o in offsets]))
        .when(n >= 2, F.concat(back(0), back(1)))
        .otherwise(back(0))
    )


# Names of the state combinations and their channel order.
STATE_COMBOS = {
    "activation": ("activation",),
    "attention": ("attention",),
    "ff": ("ff",),
    "attn_ff": ("attention", "ff"),
    "attn_act": ("attention", "activation"),
    "ff_act": ("ff", "activation"),
    "all": ("activation", "attention", "ff"),
}


def stack_states(activation: Column, attention: Column, ff: Column, combo: str) -> Column:
    """[L, d] states stacked on a last axis: array<array<array<double>>>."""
    given = {"activation": activation, "attention": attention, "ff": ff}
    if combo not in STATE_COMBOS:
        raise ValueError(f"unknown state combination: {combo}")
    channels = [given[name] for name in STATE_COMBOS[combo]]
    layers = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(channels)])
    names = [f"c{i}" for i in range(len(channels))]

    def cells(layer: Column) -> Column:
        stacked = F.transform(layer[names[0]], lambda x: F.array(x))
        for name in names[1:]:
            stacked = F.zip_with(stacked, layer[name], lambda acc, x: F.array_append(acc, x))
        return stacked

    return F.transform(layers, cells)


def storage_type(v: Column, limit: float = 60000.0) -> Column:
    """struct(dtype, overflow): float32 when any magnitude exceeds the limit."""
    overflow = F.size(F.filter(v, lambda x: F.abs(x) > limit))
    return F.struct(
        F.when(overflow > 0, F.lit("float32")).otherwise(F.lit("float16")).alias("dtype"),
        overflow.alias("overflow"),
    )


def is_nonfinite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def zero_nonfinite(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(is_nonfinite(x), F.lit(0.0)).otherwise(x))


# The field names of the result.
def region_stats(attention: Column, vision_start: Column, vision_end: Column, text_end: Column) -> Column:
    """Sums and shares of the other / vision / text / generated ranges of an attention vector."""
    n = F.size(attention)
    v_end = F.least(vision_end, n)
    t_end = F.least(text_end, n)
    whole = total(attention)

    def part(lo: Column, hi: Column) -> Column:
        return total(F.filter(attention, lambda x, i: (i >= lo) & (i < hi)))

    sums = {
        "other": part(F.lit(0), vision_start),
        "vision": part(vision_start, v_end),
        "text": part(v_end, t_end),
        "generated": part(t_end, n),
    }
    empty = attention.isNull() | (n == 0)

    def guard(value: Column, fallback: Column) -> Column:
        return F.when(empty, fallback).otherwise(value)

    zero = F.lit(0.0)
    fields = [guard(s, zero).alias(f"total_to_{k}") for k, s in sums.items()]
    fields += [
        guard(F.when(whole > 0, s / whole).otherwise(zero), zero).alias(f"pct_to_{k}")
        for k, s in sums.items()
    ]
    fields += [
        guard(entropy(attention), zero).alias("entropy"),
        guard(argmax(attention), F.lit(0)).alias("max_position"),
        guard(F.array_max(attention), zero).alias("max_value"),
    ]
    return F.struct(*fields)


# The field names of the result.
def marker_span(ids: Column, rule: str, start: Column, end: Column | None = None) -> Column:
    """Span of marked positions in an id sequence, with the derived counts.

    ``between_ends``: first to last occurrence of ``start``;
    ``start_to_end``: first ``start`` to the first ``end`` after it. Both ends
    include the marker; no marker gives (0, 0).
    """
    first = F.array_position(ids, start).cast("int") - 1
    if rule == "between_ends":
        last = F.size(ids) - F.array_position(F.reverse(ids), start).cast("int") + 1
        begin = F.when(first >= 0, first).otherwise(0)
        stop = F.when(first >= 0, last).otherwise(0)
    elif rule == "start_to_end":
        after = let(
            first,
            lambda f: F.filter(
                F.transform(ids, lambda x, i: F.when((x == end) & (i > f), i)), lambda i: i.isNotNull()
            ),
        )
        begin = F.when(first >= 0, first).otherwise(0)
        stop = F.when(first >= 0, F.array_min(after) + 1).otherwise(0)
    else:
        raise ValueError(f"unknown span rule: {rule}")
    n = F.size(ids)
    return F.struct(
        begin.alias("vision_start"),
        stop.alias("vision_end"),
        stop.alias("text_start"),
        n.alias("text_end"),
        (stop - begin).alias("num_vision"),
        (n - stop).alias("num_text"),
        begin.alias("num_other"),
    )


def pad(seq: Column, length: int, width: int) -> Column:
    """First ``length`` steps of a sequence of vectors, zero padded."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), length)
    return F.slice(F.concat(seq, zero), 1, length)


def uniform(key: Column, position: Column, salt: str = "") -> Column:
    """Deterministic uniform in (0, 1) from a row key and a position."""
    text = F.concat_ws("_", key.cast("string"), position.cast("string"), F.lit(salt))
    head = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (head + 0.5) / F.lit(float(1 << 48))


def gaussian(key: Column, position: Column, salt: str = "") -> Column:
    """Deterministic standard normal by the Box-Muller transform."""
    u = uniform(key, position, salt + "u")
    v = uniform(key, position, salt + "v")
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def noise_view(v: Column, key: Column, std: float = 0.10, salt: str = "noise") -> Column:
    """Additive noise, clipped to [0, 1]."""
    return F.transform(
        v,
        lambda x, i: F.least(
            F.greatest(x + gaussian(key, i, salt) * std, F.lit(0.0)), F.lit(1.0)
        ),
    )


def null_view(v: Column, key: Column, kind: str, radius: int = 1, salt: str = "null") -> Column:
    """Content-free stand-in for a vector: constant, uniform noise, smoothed or shuffled."""
    if kind == "constant":
        return F.transform(v, lambda x: F.lit(1.0))
    if kind == "uniform_noise":
        return F.transform(v, lambda x, i: uniform(key, i, salt))
    if kind == "smoothed":
        def around(x: Column, i: Column) -> Column:
            start = F.greatest(i - radius, F.lit(0))
            return let(F.slice(v, start + 1, i + radius - start + 1), lambda near: total(near) / F.size(near))

        return F.transform(v, around)
    if kind == "shuffled":
        keyed = F.transform(v, lambda x, i: F.struct(uniform(key, i, salt).alias("u"), i.alias("i"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])
    raise ValueError(f"unknown null view: {kind}")
