"""Language identification that fuses text likelihoods with what a page says and where it is from.

log P(language | all) is, up to a constant, the sum of a tempered text likelihood,
log P(declared language | language), log P(address suffix | language), and
log P(language | host). The three tables are soft counts of text posteriors by
grouped aggregation over all rows; a host's distribution is smoothed towards its
domain's, and that towards the whole corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import free_names, stored, unit

BUCKETS = 1 << 15
SAMPLE_PER_LANGUAGE = 2000  # labelled rows the text model is fitted on, in expectation, for each language
DENSE_LANGUAGES = 64  # above that the n-gram table is kept by its non-zero counts
EVIDENCE = 40.0  # a long text counts as so many independent n-grams
KAPPA = 5.0  # rows' worth of the parent's distribution in a host's


def _grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, space-padded, white space and digits folded."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    x = np.where((raw <= 64) & (raw != 39), 32, raw).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    keep = ~((x[:-2] == 32) & (x[1:-1] == 32))
    return (h[keep] * np.uint32(0x27D4EB2F)) >> np.uint32(17)


class SparseModel:
    """log P(n-gram | language) for many languages: one number for all unseen n-grams of a language, the seen ones by n-gram."""

    def __init__(self, languages: int, language: np.ndarray, gram: np.ndarray, n: np.ndarray):
        total = np.bincount(language, n, languages) + 0.1 * BUCKETS
        self.unseen = np.log(0.1 / total)
        order = np.argsort(gram, kind="stable")
        self.language = language[order].astype(np.int32)
        self.gain = np.log((n[order] + 0.1) / 0.1).astype(np.float32)
        self.start = np.searchsorted(gram[order], np.arange(BUCKETS + 1))

    def sums(self, grams: np.ndarray) -> np.ndarray:
        held = np.bincount(grams, minlength=BUCKETS)
        out = self.unseen * len(grams)
        for g in np.nonzero(held)[0]:
            lo, hi = self.start[g], self.start[g + 1]
            out[self.language[lo:hi]] += held[g] * self.gain[lo:hi]  # a language has an n-gram once
        return out


def fit_text_model(labelled: DataFrame, text: str, label: str, id: str) -> tuple[list[str], np.ndarray | SparseModel]:
    """All labels and log P(n-gram | language), from a sample drawn by a hash of the row and bounded for each label."""
    seen = labelled.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 0))
    counts = stored(seen.groupBy(F.col(label).alias("_label")).count(), "languages")
    languages = sorted(r[0] for r in counts.select("_label").collect())
    if not languages:
        return [], np.zeros((0, BUCKETS), np.float32)
    rate = F.broadcast(counts.select("_label", (F.lit(float(SAMPLE_PER_LANGUAGE)) / F.col("count")).alias("_rate")))
    sample = seen.join(rate, F.col(label) == F.col("_label")).where(unit(F.col(id), F.col(text)) < F.col("_rate"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for rows in batches:
            for name, part in rows.groupby("label"):
                held = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                for t in part["text"]:
                    held += np.bincount(_grams(t), minlength=BUCKETS)
        for name, held in total.items():
            at = np.nonzero(held)[0]
            yield pd.DataFrame({"label": name, "gram": at, "n": held[at]})

    schema = StructType([StructField("label", StringType()), StructField("gram", LongType()), StructField("n", LongType())])
    grams = sample.select(F.col(label).alias("label"), F.col(text).alias("text")).mapInPandas(count, schema).groupBy("label", "gram").agg(F.sum("n").alias("n"))
    place = {name: k for k, name in enumerate(languages)}
    found = grams.toPandas()  # at most BUCKETS a language, and no more than its sample has
    language, gram, n = found["label"].map(place).to_numpy(np.int64), found["gram"].to_numpy(), found["n"].to_numpy()
    if len(languages) > DENSE_LANGUAGES:
        return languages, SparseModel(len(languages), language, gram, n)
    table = np.full((len(languages), BUCKETS), 0.1)
    table[language, gram] += n
    return languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _scores(model: np.ndarray | SparseModel):
    """Column function: tempered log likelihoods; null for a text without letters or one no language explains."""

    @pandas_udf(ArrayType(DoubleType()))
    def of(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            grams = _grams(t) if t else np.zeros(0, np.uint32)
            letters = bool(t) and any(c.isalpha() for c in t)
            if not letters or not len(grams):
                out.append(None)
                continue
            # the counts of a long text are few numbers: one pass whatever its length
            used = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS else None
            if isinstance(model, SparseModel):
                sums = model.sums(grams)
            else:
                sums = model @ used.astype(np.float32) if used is not None else model[:, grams].sum(1, dtype=np.float64)
            mean = sums / len(grams)
            # worse than drawing n-grams blindly in every language: none of them
            out.append(None if mean.max() < -np.log(BUCKETS) else mean * min(len(grams), EVIDENCE + np.log1p(len(grams))))
        return pd.Series(out, dtype=object)

    return of


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda s: s / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def fuse(
    pages: DataFrame, languages: list[str], model: np.ndarray | SparseModel, min_posterior: float = 0.5, kappa: float = KAPPA
) -> DataFrame:
    """Add ``language``, ``posterior`` and ``accepted`` to rows with ``text``, ``declared``, ``suffix``, ``host``, ``domain``.

    Missing evidence (null or empty) adds nothing. Rows whose text has no letters, or is
    explained by no language, or whose best language stays below ``min_posterior``,
    are not accepted; the former have a null language. All columns are kept but ``text``.
    """
    if not languages:
        return pages.select(
            *[c for c in pages.columns if c != "text"], F.lit(None).cast("string").alias("language"),
            F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"),
        )
    n = len(languages)
    scored = stored(pages.withColumn("_s", _scores(model)(F.col("text"))).drop("text"), "languages")
    seen = scored.where(F.col("_s").isNotNull()).withColumn("_p", _softmax(F.col("_s")))

    def soft(by: list[str]) -> DataFrame:
        rows = seen if not by else seen.where(F.coalesce(F.col(by[-1]), F.lit("")) != "")
        if n > DENSE_LANGUAGES:  # too many for a column each
            long = rows.select(*by, F.posexplode("_p").alias("k", "p")).where(F.col("p") > 0).groupBy(*by, "k").agg(F.sum("p").alias("p"))
            held = long.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("m"))
            return held.select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("n"))
        sums = [F.sum(F.get("_p", F.lit(k))).alias(f"s{k}") for k in range(n)]
        return rows.groupBy(*by).agg(F.array(*sums).alias("n"))

    whole = (soft([]).first() or {"n": None})["n"] or [0.0] * n
    whole = [(x or 0.0) + 1.0 for x in whole]
    base = F.array(*[F.lit(x / sum(whole)) for x in whole])
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    toward = lambda a, b: F.zip_with(a, b, lambda x, y: (x + kappa * y) / (mass(a) + kappa))
    domains = stored(soft(["domain"]).select("domain", toward(F.col("n"), base).alias("d")), "languages")
    hosts = soft(["domain", "host"]).join(domains, "domain", "left")
    hosts = stored(hosts.select(F.col("host").alias("_host"), F.col("domain").alias("_domain"), toward(F.col("n"), F.coalesce("d", base)).alias("_h")), "languages")

    def given(by: str) -> DataFrame:
        """log P(value | language), with one row's worth of every value added."""
        table = soft([by])
        logs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.log((F.get("n", k) + 1.0) / (F.get(F.array(*[F.lit(x) for x in whole]), k) + 2.0)))
        return stored(table.select(F.col(by).alias(f"_of_{by}"), logs.alias(f"_l_{by}")), "languages")

    declared, suffix = given("declared"), given("suffix")
    zero = F.array(*[F.lit(0.0)] * n)
    joined = (
        scored.join(hosts, (scored["host"] == hosts["_host"]) & (scored["domain"] == hosts["_domain"]), "left")
        .join(declared, scored["declared"] == declared["_of_declared"], "left")
        .join(suffix, scored["suffix"] == suffix["_of_suffix"], "left")
    )
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(F.coalesce("_h", base), lambda x: F.log(x))
    total = add(add(F.col("_s"), prior), add(F.coalesce("_l_declared", zero), F.coalesce("_l_suffix", zero)))
    fused = joined.withColumn("_post", _softmax(total))
    best = F.array_max("_post")
    names = F.array(*[F.lit(x) for x in languages])
    language = F.element_at(names, F.array_position("_post", best).cast("int"))
    return fused.select(
        *[c for c in pages.columns if c != "text"],
        F.when(F.col("_s").isNotNull(), language).alias("language"), best.alias("posterior"),
        F.coalesce(F.col("_s").isNotNull() & (best >= min_posterior), F.lit(False)).alias("accepted"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence of plain documents: their label stands for the markup, their source for the host."""
    return docs.select(
        "doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
        F.col("source").alias("host"), F.lit("documents").alias("domain"),
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: visible text, the html element's language, and the parts of the address."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    labels = F.split(host, r"\.")
    return pages.select(
        F.lit(None).cast("bigint").alias("doc_id"), "page_id", bare.alias("text"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)).alias("declared"),
        F.element_at(labels, -1).alias("suffix"), host.alias("host"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
    )


def identify(docs: DataFrame, pages: DataFrame | None = None, min_posterior: float = 0.5) -> DataFrame:
    """``doc_id`` or ``page_id`` with ``language``, ``posterior`` and ``accepted`` for each row of both tables.

    The text model is fitted on the documents' labels.
    """
    languages, model = fit_text_model(docs, "text", "lang", "doc_id")
    rows = from_documents(docs)
    if pages is not None:
        rows = rows.unionByName(from_pages(pages))
    return fuse(rows, languages, model, min_posterior).select("doc_id", "page_id", "declared", "host", "language", "posterior", "accepted")


def accepted_documents(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """The rows whose language is accepted, as they are. Rows alike in id, text and labels share their fate.

    Null and empty texts and those without letters are refused. Columns may have any names; an empty table gives no rows.
    """
    k1, k2 = F.xxhash64("doc_id", "text", "lang", "source"), F.xxhash64(F.lit(1), "source", "lang", "text", "doc_id")
    languages, model = fit_text_model(docs, "text", "lang", "doc_id")
    rows = docs.select(k1.alias("_k1"), k2.alias("_k2"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit("documents").alias("domain"))
    # stored, so that its size is known and Spark broadcasts it where it is small enough
    refused = stored(fuse(rows, languages, model, min_posterior).where(~F.col("accepted")).select("_k1", "_k2").distinct(), "languages")
    names = free_names(docs, "_k1", "_k2")
    return docs.withColumns(dict(zip(names, (k1, k2)))).join(refused.toDF(*names), names, "left_anti").select(*docs.columns)
