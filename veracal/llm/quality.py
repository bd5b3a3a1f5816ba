"""Quality rules: statistics of whole documents, base rules, and gradient-boosted trees over the statistics.

Texts are read once, for their statistics. Trees are fitted on the driver to a bounded sample of labelled documents that
pass the base rules (``SAMPLE_ROWS``, the smallest hashes of the document id), and kept as flat numpy node arrays; all
documents are scored by walking all trees of a slice at once. A document with more symbols, more repeated lines, more
repeated words or more exclamation marks a word, all else being equal, never gets a better score.

Defined cases: a null or empty text has no words and so fails the base rules; labels that are null are left out; repeated
rows each get a row; a document id with several labels counts with each; without labels of both kinds every document that
passes the base rules is kept. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import stored

#: Labelled documents that the trees are fitted to, at most.
SAMPLE_ROWS = 50_000
TREES = 80
SLICE_ROWS = 500

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = [*BASE, "n_lines", "n_distinct", "n_upper", "n_digits", "n_shouts", "n_closed"]

#: Features of the trees, and the direction in which the score may go with each (0: any).
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "line_words": 0,
    "distinct": 0, "upper": 0, "digits": 0, "shouts": -1, "closed": 0,
}


# --- statistics ---


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = len(known)
    key = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 21:
        key = np.unique(key, return_inverse=True)[1]
    key = key * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    window = np.zeros(n - 2, bool)
    window[order[1:][same]] = True
    window[order[:-1][same]] = True
    word = np.zeros(n, bool)
    for k in range(3):
        word[k : n - 2 + k] |= window
    return int(word.sum())


def text_stats(data: bytes | None) -> list[int]:
    """The numbers named in ``STATS``, of a text in UTF-8."""
    if not data:
        return [0] * len(STATS)
    words = data.split()
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    n_lines = lines.total()
    closed = sum(n for line, n in lines.items() if line.rstrip()[-1] in b".!?")
    chars = int(seen.sum() - seen[0x80:0xC0].sum() - seen[list(SPACES)].sum())
    return [
        len(words), chars, int(seen[list(SYMBOLS)].sum()), n_lines - len(lines), _repeated(words),
        n_lines, len(set(words)), int(seen[65:91].sum()), int(seen[48:58].sum()), int(seen[33]), closed,
    ]


def document_stats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, one long for each of ``STATS``)."""
    schema = StructType([StructField("doc_id", df.schema[doc_id].dataType), *[StructField(name, LongType()) for name in STATS]])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = np.array([text_stats(t) for t in part.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in found.T]], names=schema.names)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(work, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(stats: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each row of ``STATS``."""
    s = dict(zip(STATS, np.asarray(stats, float).T))
    words, lines, chars = (np.maximum(s[k], 1) for k in ("n_words", "n_lines", "word_chars"))
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_words"] / lines, s["n_distinct"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_shouts"] / words, s["n_closed"] / lines,
    ], axis=1)


# --- trees ---


@dataclass
class Trees:
    """Node arrays of all trees. A row goes from node i to ``child[i]``, or to the next one if ``feature[i]`` is above
    ``threshold[i]``; a leaf is its own child, and nothing is above its threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = self.child[node] + (x[rows, self.feature[node]] > self.threshold[node])
        return self.start + self.value[node].sum(axis=1)


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0
) -> Trees:
    """Boosted trees for the log odds of ``y``: second-order gains over quantile bins.

    A split on a feature with a direction must put its two values in that order, and the middle between them bounds all
    values below either side, so the whole sum is monotone in that feature. A side of a split has a hessian of ``least``
    at least.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.empty(0) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    slots = max(len(c) for c in cuts) + 1
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if n else 0.5
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    feature, threshold, child, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append(len(child))
        value.append(0.0)
        return len(child) - 1

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        """(gain, feature, cut, left value, right value)."""
        flat = codes[rows] + np.arange(width) * slots
        sums = [np.bincount(flat.ravel(), np.repeat(w[rows], width), width * slots).reshape(width, slots) for w in (g, h)]
        (gl, hl), (gt, ht) = (np.cumsum(s, axis=1) for s in sums), (g[rows].sum(), h[rows].sum())
        gl, hl = gl[:, :-1], hl[:, :-1]
        gr, hr = gt - gl, ht - hl
        left, right = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
        whole = np.clip(-gt / (ht + ridge), low, high)
        # the loss that a value takes away, also where a bound cut it off
        gain = sum(-(a * w + 0.5 * (b + ridge) * w * w) for a, b, w in ((gl, hl, left), (gr, hr, right)))
        gain = gain + (gt * whole + 0.5 * (ht + ridge) * whole * whole)
        sign = np.array(directions)[:, None]
        fits = (hl >= least) & (hr >= least) & (sign * (right - left) >= 0)
        fits &= np.arange(slots - 1) < np.array([len(c) for c in cuts])[:, None]
        gain = np.where(fits, gain, 0.0)
        f, c = np.unravel_index(int(gain.argmax()), gain.shape)
        return gain[f, c], int(f), int(c), left[f, c], right[f, c]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            gain, f, c, left, right = best(rows, g, h, low, high) if level < depth and len(rows) else (0.0, 0, 0, 0.0, 0.0)
            if gain <= 1e-9:
                value[at] = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
                margin[rows] += value[at]
                continue
            child[at], _ = node(), node()
            feature[at], threshold[at] = f, float(cuts[f][c])
            over = codes[rows, f] > c
            middle = (left + right) / 2
            below, above = ((low, middle), (middle, high)) if directions[f] > 0 else ((middle, high), (low, middle)) if directions[f] < 0 else ((low, high), (low, high))
            todo += [(child[at], rows[~over], level + 1, *below), (child[at] + 1, rows[over], level + 1, *above)]
    return Trees(*(np.array(v, t) for v, t in ((feature, int), (threshold, float), (child, int), (value, float), (roots, int))), depth, start)


# --- Spark ---


def labelled_sample(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels (0 or 1) of at most ``rows`` labelled documents that pass the base rules, always the same ones."""
    known = labels.select(F.col("doc_id").alias("_of"), F.col(label).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    chosen = stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("_of")).orderBy(F.xxhash64("doc_id"), *STATS, "_y").limit(rows)
    found = chosen.select(*STATS, "_y").toPandas()
    return found[STATS].to_numpy(), (found["_y"].to_numpy() > 0).astype(float)


def fit(stats: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the sample; none, and even odds, where it does not hold both kinds."""
    if not 0 < y.sum() < len(y):
        stats, y = np.zeros((0, len(STATS))), np.zeros(0)
    return fit_trees(features(stats), y, list(FEATURES.values()), trees=TREES if len(y) else 0)


def judged(stats: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The statistics with base_failed, score (probability of good quality) and kept."""
    schema = StructType([*stats.schema.fields, StructField("score", DoubleType())])
    at = [stats.columns.index(c) for c in STATS]

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                odds = model.score(features(np.stack([part.column(k).to_numpy() for k in at], axis=1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-odds)))], names=schema.names)

    scored = stats.mapInArrow(work, schema)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, ``STATS``, score, base_failed, kept."""
    stats = stored(document_stats(docs, doc_id, text), "document-stats")
    return judged(stats, fit(*labelled_sample(stats, labels)), threshold)
