"""Ranked lexical search: an Aho-Corasick automaton of all item terms counts term frequencies straight from document texts.

There is no index of documents. Terms stand between separator bytes in the automaton and every run of separators in a text
reads as such a byte, so only whole terms match, and two neighbouring terms may share one. Documents keep the few counts
that the automaton gave them; scores are sums over its outputs, each mapped to the items that hold the term.

Items come in blocks whose terms are below ``block_bytes``, since a block's automaton is sent to every worker; each block
reads the texts anew. A block holds at least one item, whose terms are those of one row.

Defined cases: a null or empty text holds no term; documents without terms count nowhere; every row is a document of its
own, repeated rows included; rows of one item id, the null id included, form one item. Null document ids come last among
equal scores. Empty tables give no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import stored

BLOCK_BYTES = 32 << 20
#: Counted for each item besides its terms: what a task holds of it.
ITEM_BYTES = 4096
#: Documents worked off at once, and cells of their scores.
SLICE_ROWS, CELLS = 500, 1 << 21
#: Tasks whose best documents meet in one group before the groups meet.
FAN = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BEST = StructType([StructField("task", IntegerType()), StructField("item", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
COUNTED = StructType([StructField("doc_id", LongType()), StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("tfs", ArrayType(LongType()))])

_built: dict[str, ahocorasick.Automaton] = {}


def _folded() -> bytes:
    """Byte for byte: A-Z lower-cased, ASCII other than letters and digits a space."""
    out = bytearray(range(256))
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalnum() else 32
    return bytes(out)


FOLDED = _folded()


def automaton(terms: list[str], key: str | None = None) -> ahocorasick.Automaton:
    """Of the terms between separators, one character a byte; built once in each worker for a key."""
    if key in _built:
        return _built[key]
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        found.add_word(f" {term.encode().decode('latin-1')} ", i)
    found.make_automaton()
    if key is not None:
        _built.clear()
        _built[key] = found
    return found


def count_terms(text: bytes, machine: ahocorasick.Automaton) -> tuple[int, Counter]:
    """Number of all terms of a text in UTF-8, and occurrences of each term of the automaton."""
    data = text.translate(FOLDED)
    return len(data.split()), Counter(map(itemgetter(1), machine.iter(f" {data.decode('latin-1')} ")))


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def counted(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with at least one term of any kind: the automaton's outputs and their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    key = uuid.uuid4().hex

    def work(batches):
        machine = automaton(sent.value, key)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids, ns, ends, found, tfs = [], [], [0], [], []
                for doc, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, counts = count_terms(data, machine)
                    if n:
                        ids.append(doc)
                        ns.append(n)
                        found += counts.keys()
                        tfs += counts.values()
                        ends.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((found, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=COUNTED.names)

    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return named.where(F.col("text").isNotNull()).mapInArrow(work, COUNTED)


class Best:
    """The best documents of each item among those seen so far; ``least`` is the score that one must reach."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.held = [np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64)]
        self.new: list[list[np.ndarray]] = []
        self.waiting, self.limit = 0, max(1 << 16, 2 * top * items)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores`` has a row for each document and a column for each item."""
        doc, item = np.nonzero(scores >= self.least)
        self.new.append([item, scores[doc, item], null[doc], ids[doc]])
        self.waiting += len(doc)
        if self.waiting > self.limit:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """item, score, whether the id is null, id."""
        item, score, null, ids = (np.concatenate(c) for c in zip(self.held, *self.new))
        order = np.lexsort((ids, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.top - 1]
        self.least[item[last]] = score[last]
        best = order[place < self.top]
        self.held = [c[best] for c in (item, score, null, ids)]
        self.new, self.waiting = [], 0
        return self.held


def score_slice(part: pa.RecordBatch, weights: np.ndarray, starts: np.ndarray, owners: np.ndarray, items: int) -> np.ndarray:
    """Scores of each document (row) for each item (column), in 64-bit integers.

    ``owners[starts[t]:starts[t + 1]]`` are the items of term t. Outputs are mapped to items a bounded number at a time.
    """
    lists = part.column(2)
    doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
    gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * part.column(1).to_numpy()[doc]))
    many = starts[term + 1] - starts[term]
    upto = np.cumsum(many)
    out = np.zeros(part.num_rows * items, np.int64)
    at = 0
    while at < len(term):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
        n = many[at:to]
        first = np.repeat(starts[term[at:to]] - (np.cumsum(n) - n), n)
        np.add.at(out, np.repeat(doc[at:to], n) * items + owners[first + np.arange(len(first))], np.repeat(gain[at:to], n))
        at = to
    return out.reshape(part.num_rows, items)


def _best(counts: DataFrame, weights: np.ndarray, starts: np.ndarray, owners: np.ndarray, items: int, top: int) -> DataFrame:
    """(task, item, doc_id, score): the best documents that one task saw."""
    sent = counts.sparkSession.sparkContext.broadcast((weights, starts, owners))
    rows = max(1, min(SLICE_ROWS, CELLS // items))

    def work(batches):
        best = Best(items, top)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0)
                best.add(score_slice(part, *sent.value, items), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, null, ids = best.settle()
        task = np.full(len(item), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(item.astype(np.int32)), pa.array(ids, mask=null), pa.array(score)], names=BEST.names)

    return counts.select("doc_id", "m", "terms", "tfs").mapInArrow(work, BEST)


def _block(docs: DataFrame, owned: DataFrame, top: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    pairs = owned.toArrow().combine_chunks()
    terms, term = np.unique(pairs["term"].to_numpy(), return_inverse=True)
    names = pairs["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    item, items = names.indices.to_numpy(), len(names.dictionary)
    owners = item[np.argsort(term, kind="stable")].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])

    counts = stored(counted(docs, terms.tolist(), doc_id, text), "term-counts")
    total, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row a term of the block
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * total + 2) / (2 * F.col("df") + 1)))
    found = df.select("term", weight.cast("bigint").alias("w")).toPandas()
    weights = np.zeros(len(terms), np.int64)
    weights[found["term"].to_numpy()] = found["w"].to_numpy()

    m = F.expr(f"100 - 50 + (50 * n * {total}L) div {max(1, length)}L")
    best = _best(counts.withColumn("m", m), weights, starts, owners, items, top)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]

    def first_rows(rows: DataFrame, *by: Column | str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", *by).orderBy(*order))).where(F.col("rank") <= top)

    ranked = first_rows(first_rows(best, F.floor(F.col("task") / FAN)).drop("rank"))
    index = pa.table({"item": pa.array(np.arange(items, dtype=np.int32)), "item_id": names.dictionary})
    return ranked.join(spark.createDataFrame(index), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = 50, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by document id.

    A term counts once for an item. Its weight falls with the number of documents that hold it, its gain grows with its
    frequency in a document and falls with the document's length against the mean length. All numbers are integers.
    """
    named = items.select(F.col(item_id).alias("item_id"), F.explode(distinct_terms(F.col(text))).alias("term")).distinct()
    owned = stored(named, "item-terms")
    need = owned.agg(F.sum(F.octet_length("term") + 16) + ITEM_BYTES * F.count_distinct(F.struct("item_id"))).first()[0] or 0
    blocks = -(-need // block_bytes)
    out = docs.sparkSession.createDataFrame([], StructType([StructField("item_id", items.schema[item_id].dataType), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]))
    for b in range(blocks):
        mine = owned.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        if not mine.isEmpty():
            out = out.unionByName(_block(docs, mine, top, doc_id, text))
    return out
