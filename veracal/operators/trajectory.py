"""Perturbation trajectories of hidden states and the token features derived from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from ..functions import vectors as V
from .tiles import Fold, lists, pieces, tiled

# Names and order of the token features.
STATE_FEATURES = [
    "original_log_prob_actual", "original_prob_actual", "original_logit_actual",
    "original_prob_argmax", "original_logit_argmax", "original_entropy",
    "original_margin_logit_top1_top2", "original_margin_prob_top1_top2",
    "original_norm_logits_L2", "original_std_logits", "original_norm_hidden_state_L2",
    "is_actual_token_original_argmax",
]
PATH_FEATURES = ["jacobian_norm_token", "epsilon_to_flip_token", "pei_value_token"]
STEP_MEASURES = [
    "perturbed_log_prob_actual", "perturbed_prob_actual", "perturbed_logit_actual",
    "delta_log_prob_actual_from_original", "perturbed_prob_argmax", "perturbed_logit_argmax",
    "did_argmax_change_from_original", "perturbed_entropy", "perturbed_margin_logit_top1_top2",
    "perturbed_norm_logits_L2", "kl_div_perturbed_from_original", "js_div_perturbed_from_original",
    "cosine_sim_logits_perturbed_to_original", "cosine_sim_hidden_perturbed_to_original",
    "l2_dist_hidden_perturbed_from_original",
]
STATISTICS = ["mean", "std", "min", "max"]
FEATURES = STATE_FEATURES + PATH_FEATURES + [f"{m}_{s}" for m in STEP_MEASURES for s in STATISTICS]


class _Logits(Fold):
    """W h as it is, for those who ask for whole logits."""

    @staticmethod
    def cells(n: int, dim: int) -> tuple[int, int]:
        return dim + n, n * dim

    def __init__(self, n, vectors, columns):
        super().__init__(n, vectors, columns)
        (self.h, self.ok), = vectors.values()
        self.z = np.zeros((len(self.h), n))

    def tile(self, turn, at, w):
        self.z[:, at:at + len(w)] = self.h @ w.T

    def result(self):
        return [lists(self.z, self.ok)]


class _Peak:
    """Maximum, its first place, log-sum-exp and the two largest values of columns that come a few at a time."""

    def __init__(self, rows: int):
        self.top = np.full((rows, 2), -np.inf)
        self.best = np.zeros(rows, np.int64)
        self.total = np.zeros(rows)

    def add(self, rows: slice, at: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(z - maximum so far), and what earlier sums shrink by."""
        peak, place = z.max(axis=1), z.argmax(axis=1)
        before = self.top[rows, 0].copy()
        self.best[rows] = np.where(peak > before, at + place, self.best[rows])
        two = np.partition(z, -2, axis=1)[:, -2:] if z.shape[1] > 1 else z
        self.top[rows] = np.sort(np.concatenate([self.top[rows], two], axis=1), axis=1)[:, :-3:-1]
        now = self.top[rows, 0]
        e, shrink = np.exp(z - now[:, None]), np.exp(before - now)
        self.total[rows] = self.total[rows] * shrink + e.sum(axis=1)
        return e, shrink

    def log_sum(self) -> np.ndarray:
        return self.top[:, 0] + np.log(self.total)


class _Gradient(Fold):
    """sum of p_i * w_i minus the token's own row, with sums that shrink whenever the maximum grows."""

    def __init__(self, n, vectors, columns):
        super().__init__(n, vectors, columns)
        (self.h, self.ok), = vectors.values()
        token = columns["_token"].cast("int64").fill_null(-1).to_numpy()
        self.token, self.named = np.maximum(token, 0), (token >= 0) & (token < n)
        self.peak = _Peak(len(self.h))
        self.g, self.own = np.zeros_like(self.h), np.full(self.h.shape, np.nan)
        self.token_logit = np.full(len(self.h), np.nan)

    def product(self, rows: slice, at: int, w: np.ndarray) -> np.ndarray:
        z = self.h[rows] @ w.T
        e, shrink = self.peak.add(rows, at, z)
        self.g[rows] = self.g[rows] * shrink[:, None] + e @ w
        mine = np.flatnonzero(self.named[rows] & (self.token[rows] >= at) & (self.token[rows] < at + len(w)))
        local = self.token[rows][mine] - at
        self.own[rows.start + mine] = w[local]
        self.token_logit[rows.start + mine] = z[mine, local]
        return z

    def tile(self, turn, at, w):
        for rows in pieces(len(self.h), len(w)):
            self.product(rows, at, w)

    def between(self, turn):
        if turn == 1:
            self.g = self.g / self.peak.total[:, None] - self.own

    def result(self):
        return [lists(self.g, self.ok & self.named)]


def _line(radius: float, steps: int) -> type[Fold]:
    """A fold over the states h + k * (R / S) * g / |g|: three passes, since the divergences need both normalisers.

    Logits along the line are those of h plus a multiple of those of the direction, so a block meets two vectors a row,
    whatever the number of steps.
    """

    class Line(_Gradient):
        passes = 3

        @staticmethod
        def cells(n: int, dim: int) -> tuple[int, int]:
            return 6 * dim + steps * (len(STEP_MEASURES) + 8) + 32, n * (2 * dim + 20 * steps)

        def __init__(self, n, vectors, columns):
            super().__init__(n, vectors, columns)
            rows = len(self.h)
            # count, mean and squared distance from the mean of the logits, merged block by block
            self.seen, self.mean, self.spread, self.square = 0, np.zeros(rows), np.zeros(rows), np.zeros(rows)
            self.entropy = np.zeros(rows)
            self.peaks = [_Peak(rows) for _ in range(steps)]
            self.sums = {name: np.zeros((steps, rows)) for name in ("token", "square", "with", "shift", "entropy", "js")}

        def product(self, rows, at, w):
            z = super().product(rows, at, w)
            mean, count = z.mean(axis=1), z.shape[1]
            away = mean - self.mean[rows]
            share = count / (self.seen + count)
            self.spread[rows] += ((z - mean[:, None]) ** 2).sum(axis=1) + away**2 * self.seen * share
            self.mean[rows] += away * share
            self.square[rows] += (z * z).sum(axis=1)
            return z

        def tile(self, turn, at, w):
            if turn == 1:
                super().tile(turn, at, w)
                self.seen += len(w)
                return
            for rows in pieces(len(self.h), len(w) * 4):
                z, move = self.h[rows] @ w.T, self.direction[rows] @ w.T
                l0 = z - self.norm[rows, None]
                p0 = np.exp(l0)
                mine = np.flatnonzero(self.named[rows] & (self.token[rows] >= at) & (self.token[rows] < at + len(w)))
                local = self.token[rows][mine] - at
                if turn == 2:
                    self.entropy[rows] -= (p0 * np.log(p0 + V.EPS)).sum(axis=1)
                for k in range(steps):
                    zk = z + (k + 1) * (radius / steps) * move
                    if turn == 2:
                        self.peaks[k].add(rows, at, zk)
                        self.sums["token"][k, rows.start + mine] = zk[mine, local]
                        self.sums["square"][k, rows] += (zk * zk).sum(axis=1)
                        self.sums["with"][k, rows] += (z * zk).sum(axis=1)
                        self.sums["shift"][k, rows] += (p0 * (z - zk)).sum(axis=1)
                    else:
                        lk = zk - self.norms[k][rows, None]
                        pk = np.exp(lk)
                        mid = 0.5 * (p0 + pk)
                        log_mid = np.log(np.where(mid > 0, mid, 1.0))
                        self.sums["entropy"][k, rows] -= (pk * np.log(pk + V.EPS)).sum(axis=1)
                        self.sums["js"][k, rows] += (mid * (log_mid - 0.5 * (l0 + lk))).sum(axis=1)

        def between(self, turn):
            super().between(turn)
            if turn == 1:
                self.norm = self.peak.log_sum()
                self.length = np.linalg.norm(self.g, axis=1)
                moves = self.length > 1e-9
                self.direction = np.where(moves[:, None], self.g / np.where(moves, self.length, 1.0)[:, None], 0.0)
            elif turn == 2:
                self.norms = [p.log_sum() for p in self.peaks]

        def measures(self) -> np.ndarray:
            """Step x measure x row, in the fixed order of the measures."""
            out = []
            size, h2 = np.sqrt(self.square), np.linalg.norm(self.h, axis=1)
            named = np.where(self.named, 1.0, np.nan)
            for k, (peak, norm) in enumerate(zip(self.peaks, self.norms)):
                s = {name: v[k] for name, v in self.sums.items()}
                moved = (k + 1) * (radius / steps) * self.direction
                hk, far = self.h + moved, np.sqrt(s["square"])
                log_token = s["token"] * named - norm
                out.append([
                    log_token, np.exp(log_token), s["token"] * named, self.token_logit - self.norm - log_token,
                    np.exp(peak.top[:, 0] - norm), peak.top[:, 0], (peak.best != self.peak.best).astype(float),
                    s["entropy"], _gap(peak.top), far, s["shift"] - self.norm + norm, s["js"],
                    s["with"] / (np.maximum(size, 1e-8) * np.maximum(far, 1e-8)),
                    (self.h * hk).sum(axis=1) / (np.maximum(h2, 1e-8) * np.maximum(np.linalg.norm(hk, axis=1), 1e-8)),
                    np.linalg.norm(moved, axis=1),
                ])
            return np.array(out)

        def states(self) -> list[np.ndarray]:
            """The features of the unperturbed states, in their fixed order."""
            named = np.where(self.named, 1.0, np.nan)
            log_token, top = self.token_logit - self.norm, self.peak.top
            return [
                log_token, np.exp(log_token), self.token_logit, np.exp(top[:, 0] - self.norm), top[:, 0], self.entropy,
                _gap(top), _gap(np.exp(top - self.norm[:, None])), np.sqrt(self.square),
                np.sqrt(self.spread / (self.n - 1)) if self.n > 1 else np.full(len(self.h), np.nan),
                np.linalg.norm(self.h, axis=1), (self.peak.best == self.token) * named,
            ]

        def column(self, values: np.ndarray) -> pa.Array:
            return pa.array(np.ascontiguousarray(values, dtype=float), mask=~(self.ok & self.named))

    return Line


def _gap(top: np.ndarray) -> np.ndarray:
    """Gap between the two largest values; 0 where there is one."""
    return np.where(np.isinf(top[:, 1]), 0.0, top[:, 0] - top[:, 1])


def project(df: DataFrame, W: DataFrame, key: list[str], vec: str = "h", out: str = "logits", tile_rows: int | None = None) -> DataFrame:
    """logits = W h. Null where the vector is null or not as wide as the matrix."""
    return tiled(df, W, key, [vec], _Logits, [StructField(out, ArrayType(DoubleType()))], tile_rows)


def gradient(df: DataFrame, W: DataFrame, key: list[str], vec: str = "h", token: str = "token_id", out: str = "g", tile_rows: int | None = None) -> DataFrame:
    """Cross-entropy gradient in hidden space: sum of p_i * w_i minus the token's own row. Logits are never whole.

    Null where the vector is absent or the token is not a row of the matrix.
    """
    named = df.withColumn("_token", F.col(token).cast("bigint"))
    return tiled(named, W, key, [vec], _Gradient, [StructField(out, ArrayType(DoubleType()))], tile_rows).drop("_token")


def trajectory(df: DataFrame, radius: float = 20.0, steps: int = 5, vec: str = "h", direction: str = "g",
               out: str = "h_k") -> DataFrame:
    """One row per step k = 1..S with h + k * (R / S) * g / |g|; a vanishing g leaves h unchanged."""

    def walk(norm: Column) -> Column:
        def at(k: Column) -> Column:
            moved = F.zip_with(vec, direction, lambda h, g: h + k * F.lit(radius / steps) * (g / norm))
            return F.struct(k.alias("step"), F.when(norm > 1e-9, moved).otherwise(F.col(vec)).alias(out))

        return F.transform(F.sequence(F.lit(1), F.lit(steps)), at)

    return df.select("*", F.inline(V.let(V.l2(F.col(direction)), walk)))


def step_measures(df: DataFrame, W: DataFrame, key: list[str], radius: float = 20.0, steps: int = 5, vec: str = "h", token: str = "token_id", tile_rows: int | None = None) -> DataFrame:
    """One row a step, (key, token, step, measures), for states moved along their gradient. Needs ``vec`` and the token id.

    Measures are null where the vector is absent or the token is not a row of the matrix.
    """

    class Steps(_line(radius, steps)):
        def result(self):
            values = self.measures()
            return [lists(values[:, m, :].T, self.ok & self.named) for m in range(len(STEP_MEASURES))]

    arrays = [StructField(f"_m{i}", ArrayType(DoubleType())) for i in range(len(STEP_MEASURES))]
    found = tiled(df.select(*key, token, vec, F.col(token).cast("bigint").alias("_token")), W, key, [vec], Steps, arrays, tile_rows)
    number = F.sequence(F.lit(1), F.lit(steps))
    rows = F.transform(number, lambda k: F.struct(k.alias("step"), *[F.element_at(a.name, k).alias(m) for a, m in zip(arrays, STEP_MEASURES)]))
    return found.select(*key, token, F.inline(rows))


def radius_to_flip(measures: DataFrame, by: list[str], radius: float = 20.0, steps: int = 5) -> DataFrame:
    """Smallest radius at which the top token changes, +inf if it never does."""
    flipped = F.min(F.when(F.col("did_argmax_change_from_original") == 1, F.col("step")))
    return measures.groupBy(*by).agg(
        F.coalesce(flipped * F.lit(radius / steps), F.lit(float("inf"))).alias("epsilon_to_flip_token")
    )


def _energy(steps: int) -> Column:
    """Trapezoid over f_0 = 0, f_k = max(0, drop_k): the last value counts half."""
    f = F.greatest(F.lit(0.0), F.col("delta_log_prob_actual_from_original"))
    return F.sum(F.when(F.col("step") == steps, f / 2.0).otherwise(f)) / F.lit(float(steps))


def perturbation_energy(measures: DataFrame, by: list[str], steps: int = 5) -> DataFrame:
    return measures.groupBy(*by).agg(_energy(steps).alias("pei_value_token"))


def trajectory_statistics(measures: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population std, min and max of every measure over the steps."""
    ops = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return measures.groupBy(*by).agg(*[ops[s](m).alias(f"{m}_{s}") for m in STEP_MEASURES for s in STATISTICS])


def trajectory_features(df: DataFrame, W: DataFrame, key: list[str], radius: float = 20.0, steps: int = 5, vec: str = "h",
                        token: str = "token_id", tile_rows: int | None = None) -> DataFrame:
    """All token features: (key, token, ``FEATURES``). ``df`` has the key, ``vec`` and the token id.

    Features are null where the vector is absent or the token is not a row of the matrix.
    """

    class Features(_line(radius, steps)):
        def result(self):
            values = self.measures()
            changed = values[:, STEP_MEASURES.index("did_argmax_change_from_original")] == 1
            first = np.where(changed.any(axis=0), (changed.argmax(axis=0) + 1) * (radius / steps), np.inf)
            drops = np.maximum(values[:, STEP_MEASURES.index("delta_log_prob_actual_from_original")], 0.0)
            energy = (drops.sum(axis=0) - drops[-1] / 2.0) / steps
            of = {"mean": values.mean(axis=0), "std": values.std(axis=0), "min": values.min(axis=0), "max": values.max(axis=0)}
            stats = [of[s][m] for m in range(len(STEP_MEASURES)) for s in STATISTICS]
            return [self.column(v) for v in [*self.states(), self.length, first, energy, *stats]]

    out = [StructField(name, DoubleType()) for name in FEATURES]
    found = tiled(df.select(*key, token, vec, F.col(token).cast("bigint").alias("_token")), W, key, [vec], Features, out, tile_rows)
    return found.select(*key, token, *FEATURES)
