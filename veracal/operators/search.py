"""Search over probe configurations: all of them are fitted together, scored together, and the best is picked.

Every gradient step is one pass over the training rows. A task adds up the gradients of all configurations over its rows
in one Arrow function, cut into chunks that the executors sum; the driver holds the parameters, whose number the budget
filter bounds, and never a row. Training rows are not cached: give a stored table where they are costly to derive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .curate import best_trial
from .metrics import validation_score
from .probe import VARIANTS

CHUNK = 256
PARTIAL = StructType([StructField("chunk", IntegerType()), StructField("v", ArrayType(DoubleType()))])
Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Config:
    """A probe and how it is trained; ``hidden`` empty is the linear probe."""

    name: str
    hidden: tuple[int, ...] = ()
    variant: str = "full"
    lr: float = 0.5
    beta: float = 1.0
    lam: float = 1.0
    margin: float = 0.1
    decay: float = 0.0
    seed: int = 0

    def start(self, dim: int) -> Layers:
        """Zero weights for a linear probe, scaled normal ones where there are hidden layers."""
        draw = np.random.default_rng(self.seed)
        sizes = [dim, *self.hidden, 1]
        scale = [np.sqrt(2.0 / a) if self.hidden else 0.0 for a in sizes]
        return [(draw.normal(size=(b, a)) * s, np.zeros(b)) for a, b, s in zip(sizes, sizes[1:], scale)]


@dataclass(frozen=True)
class Totals:
    """What losses are divided by: rows, positive weight, and positives whose blank view counts."""

    n: int
    pos_weight: float
    active: float


@dataclass
class Fitted:
    layers: Layers
    losses: list[float] = field(default_factory=list)


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The input of every layer, then the logits."""
    seen = [x]
    for k, (w, b) in enumerate(layers):
        z = seen[-1] @ w.T + b
        seen.append(z if k == len(layers) - 1 else np.maximum(z, 0.0))
    return seen


def _backward(layers: Layers, seen: list[np.ndarray], dz: np.ndarray, into: Layers) -> None:
    down = dz[:, None]
    for k in range(len(layers) - 1, -1, -1):
        into[k][0][:] += down.T @ seen[k]
        into[k][1][:] += down.sum(axis=0)
        if k:
            down = (down @ layers[k][0]) * (seen[k] > 0)


def loss_and_gradient(config: Config, layers: Layers, x: np.ndarray, blank: np.ndarray, y: np.ndarray, mask: np.ndarray, totals: Totals, into: Layers) -> float:
    """This batch's share of the loss; its share of the gradient is added to ``into``."""
    use_rank, use_brier = VARIANTS[config.variant]
    n, pw = totals.n, totals.pos_weight
    seen = forward(layers, x)
    z = seen[-1][:, 0]
    p = 1.0 / (1.0 + np.exp(-z))
    dz = ((1 - y) * p - pw * y * (1 - p)) / n
    loss = float(np.sum(pw * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z))) / n
    if use_brier:
        dz = dz + config.beta * 2 * (p - y) * p * (1 - p) / n
        loss += config.beta * float(np.sum((p - y) ** 2)) / n
    if use_rank:
        there = forward(layers, blank)
        q = 1.0 / (1.0 + np.exp(-there[-1][:, 0]))
        gap = config.margin - (p - q)
        on = (gap > 0) * y * mask / totals.active
        loss += config.lam * float(np.sum(gap * on))
        dz = dz - config.lam * on * p * (1 - p)
        _backward(layers, there, config.lam * on * q * (1 - q), into)
    _backward(layers, seen, dz, into)
    return loss


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in layers for a in pair])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at:at + w.size].reshape(w.shape), flat[at + w.size:at + w.size + b.size]))
        at += w.size + b.size
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _step(data: DataFrame, configs: list[Config], stacks: list[Layers], totals: Totals) -> tuple[list[np.ndarray], list[float]]:
    """Gradient and loss of every configuration, from one pass over the rows."""
    sent = data.sparkSession.sparkContext.broadcast(stacks)
    sizes = [sum(w.size + b.size for w, b in s) for s in stacks]
    whole = sum(sizes) + len(configs)

    def partial(batches):
        now = sent.value
        grads = [[(np.zeros_like(w), np.zeros_like(b)) for w, b in s] for s in now]
        losses = np.zeros(len(configs))
        for batch in batches:
            if batch.num_rows:
                x, blank = _vectors(batch.column(0)), _vectors(batch.column(1))
                y, mask = _numbers(batch.column(2)), _numbers(batch.column(3))
                for k, config in enumerate(configs):
                    losses[k] += loss_and_gradient(config, now[k], x, blank, y, mask, totals, grads[k])
        flat = np.concatenate([*[_flat(g) for g in grads], losses])
        cuts = list(range(0, whole, CHUNK))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([flat[c:c + CHUNK] for c in cuts], pa.list_(pa.float64()))], names=PARTIAL.names)

    def add(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        # the tasks' shares in a fixed order, so that reruns add up alike
        parts = np.sort(np.stack(rows["v"].to_numpy()), axis=0)
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "v": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    shares = data.mapInArrow(partial, PARTIAL)
    found = {r["chunk"]: r["v"] for r in shares.groupBy("chunk").applyInArrow(add, PARTIAL).collect()}
    sent.unpersist()
    flat = np.concatenate([found[c] for c in sorted(found)]) if found else np.zeros(whole)
    ends = np.cumsum([0, *sizes])
    return [flat[a:b] for a, b in zip(ends, ends[1:])], list(flat[ends[-1]:])


def fit_grid(df: DataFrame, configs: list[Config], steps: int = 50) -> dict[str, Fitted]:
    """Fit every configuration by full-batch steps, each clipped to norm 1, over (h_base, h_blank, y, mask).

    Rows with a null in any of the four are left out. ``losses`` are those before each step.
    """
    data = df.select("h_base", "h_blank", "y", "mask").dropna()
    head = data.agg(
        F.max(F.size("h_base")).alias("d"), F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("bigint")).alias("pos"),
        F.sum(F.col("y") * F.col("mask")).alias("active"),
    ).first()
    if not head["n"]:
        raise ValueError("no rows to fit")
    totals = Totals(head["n"], (head["n"] - head["pos"]) / head["pos"] if head["pos"] else 1.0, float(head["active"] or 0) + 1e-8)
    fitted = {c.name: Fitted(c.start(head["d"])) for c in configs}
    for _ in range(steps):
        grads, losses = _step(data, configs, [fitted[c.name].layers for c in configs], totals)
        for config, grad, loss in zip(configs, grads, losses):
            now = fitted[config.name]
            flat = _flat(now.layers)
            grad = grad + config.decay * flat
            now.layers = _shaped(flat - config.lr * grad * min(1.0, 1.0 / (float(np.linalg.norm(grad)) + 1e-6)), now.layers)
            now.losses.append(loss)
    return fitted


def score_grid(df: DataFrame, fitted: dict[str, Fitted], key: str, vec: str = "h_base") -> DataFrame:
    """(config, key, y, c): the confidence of every configuration for every row, from one pass. Null vectors give no row."""
    sent = df.sparkSession.sparkContext.broadcast({name: f.layers for name, f in fitted.items()})
    schema = StructType([StructField("config", StringType()), StructField(key, df.schema[key].dataType), StructField("y", LongType()), StructField("c", DoubleType())])

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(2))
                for name, layers in sent.value.items():
                    c = 1.0 / (1.0 + np.exp(-forward(layers, x)[-1][:, 0]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), batch.column(0), batch.column(1), pa.array(c)], names=schema.names)

    return df.where(F.col(vec).isNotNull()).select(key, F.col("y").cast("bigint").alias("y"), vec).mapInArrow(work, schema)


def search(train: DataFrame, valid: DataFrame, configs: list[Config], key: str, metric: str = "auroc", steps: int = 50, least: int = 1, most: int = 5_000_000) -> tuple[DataFrame, dict[str, Fitted]]:
    """One row a configuration within the parameter budget: (config, n_params, loss, score, chosen), and the fits.

    ``loss`` is the training loss before the last step, ``score`` the validation metric; of equal scores the first name is chosen.
    """
    spark = train.sparkSession
    dim = train.agg(F.max(F.size("h_base"))).first()[0] or 0
    sizes = {c.name: sum(w.size + b.size for w, b in c.start(dim)) for c in configs}
    kept = [c for c in configs if least <= sizes[c.name] <= most]
    fitted = fit_grid(train, kept, steps)
    facts = spark.createDataFrame([(c.name, sizes[c.name], float(fitted[c.name].losses[-1])) for c in kept], "config string, n_params bigint, loss double")
    scores = validation_score(score_grid(valid, fitted, key), ["config"], metric)
    rows = facts.join(scores, "config")
    best = best_trial(rows, "score", "config").select(F.col("config").alias("_best"))
    return rows.join(F.broadcast(best), F.col("config") == F.col("_best"), "left").select(*rows.columns, F.col("_best").isNotNull().alias("chosen")), fitted
