"""SimHash near duplicates with multi-index hashing.

A fingerprint is cut into segments. If two differ in at most r bits, one segment
differs in few enough bits to be found by looking up a small Hamming ball around
it in a table of that segment; each match is verified on the whole fingerprint.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from .common import batches_of, free_names, longs, stored
from .components import components, forest, tiles

SEED = 42
DENSE = 512  # fingerprints that share a segment's value; above that they are told apart by a second index


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence, if it is shorter."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    h = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[:n], ends[min(words, len(w)) - 1:])), np.uint64, n)


def fingerprint(words: int = 3):
    """Column function: the 64-bit SimHash of a text, as a signed bigint. No words: zero."""

    @pandas_udf(LongType())
    def of(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), np.int64)
        for k, t in enumerate(text):
            h = shingle_hashes(t, words)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):
                part = h[at:at + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]
        return pd.Series(out)

    return of


def _segments(count: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment: by the pigeonhole principle one of the balls holds the match."""
    cut = np.linspace(0, 64, count + 1).astype(int)
    each, full = divmod(radius, count)
    return [(int(lo), int(hi - lo), each if k <= full else each - 1) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:]))]


def _balls(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _value(bits: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND((1 << width) - 1 if width < 64 else -1)


def near_links(prints: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """Pairs (``a``, ``b``), a < b, of distinct fingerprints ``fp`` that differ in at most ``radius`` bits; none is lost."""
    found = None
    for shift, width, ball in _segments(segments, radius):
        if ball < 0:
            continue
        entry = prints.select(F.col("fp").alias("b"), _value(F.col("fp"), shift, width).alias("value"))
        at = _value(F.col("fp"), shift, width)
        probe = prints.select(
            F.col("fp").alias("a"), F.explode(F.transform(longs(_balls(width, ball)), lambda m: at.bitwiseXOR(m))).alias("value")
        )
        # where many share a value, the rest of the fingerprint is cut into radius + 1 parts, one of which is equal
        dense = entry.groupBy("value").agg(F.count("*").alias("_n")).where(F.col("_n") > DENSE).select("value", F.lit(True).alias("_dense"))
        rest = [(s, w) for s, w, _ in _segments(segments, 0) if s != shift] if segments > 1 else []
        parts = []
        for s, w in rest:
            cut = np.linspace(0, w, -(-(radius + 1) // len(rest)) + 1).astype(int)
            parts += [(s + int(lo), int(hi - lo)) for lo, hi in zip(cut[:-1], cut[1:])]

        def finer(side: DataFrame, name: str) -> DataFrame:
            keys = F.array(*[
                F.struct(F.lit(k).alias("part"), _value(F.col(name), s, w).alias("is")) for k, (s, w) in enumerate(parts)
            ])
            plain = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("is")))
            flagged = side.join(dense, "value", "left")
            return flagged.select(name, "value", F.explode(F.when(F.col("_dense"), keys).otherwise(plain)).alias("at")).select(
                name, "value", "at.part", "at.is"
            )

        near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (F.col("a") < F.col("b"))
        left, right = finer(probe, "a"), finer(entry, "b").select(*[F.col(c).alias(f"_{c}") for c in ("value", "part", "is")], "b")
        same = (left["value"] == right["_value"]) & (left["part"] == right["_part"]) & (left["is"] == right["_is"])
        # merged, never broadcast: Spark sizes both sides by the file of fingerprints, without the rows that explode adds
        pairs = left.join(right.hint("merge"), same & near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def simhash_groups(
    df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 3, radius: int = 2, segments: int = 2
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Equal fingerprints are compared once. A null text has no words, and a text
    without words has fingerprint zero, linked like any other. A null id takes
    part in links, but gives no component its name.
    """
    docs = stored(df.select(F.col(id).alias("id"), fingerprint(words)(F.col(text)).alias("fp")), "fingerprints")
    prints = stored(docs.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    roots = stored(components(near_links(prints.select("fp"), radius, segments)), "components")
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    # merged: a row a document, which Spark sizes by its compressed file
    return docs.join(known.hint("merge"), docs["fp"] == known["_fp"]).select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- Groups by exact Jaccard similarity; long fingerprints find the candidates ---

MISSED = 1e-5  # of pairs at the similarity, those that no segment's ball may find
PRINT_WORDS = 4  # 64-bit words of a fingerprint on which a match is verified
LOOSE = 5.2  # standard errors by which verified fingerprints may differ more than expected at the similarity
SHARED = 256  # fingerprints that share a segment's value, on average
PRINT_ROWS = 1 << 16  # a block of fingerprints, 32 bytes each
CELLS = 1 << 20  # pairs compared at once
SET_ROWS, SET_SHINGLES = 256, 1 << 21  # a block of shingle sets
TILE = ["bucket", "_i", "_j"]
BATCH_ROWS = 2048  # rows that reach Python at once
PAIRS = 1 << 18  # pairs found before they are thinned to a forest


def shingle_set(words: int = 5):
    """Column function: the sorted distinct shingle hashes of a text, packed."""

    @pandas_udf(BinaryType())
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in text], dtype=object)

    return of


@lru_cache
def _differing(similarity: float) -> tuple[int, int, float, float]:
    """How two different sets of at least this Jaccard similarity differ in a fingerprint bit, at worst.

    Fewest elements of such a set, most of a set that one of the fewest can be paired with, and the
    chance for pairs with a set of the fewest and for all others: counted out up to 40 elements, and with a margin
    on the angle's share of a half turn above.
    """
    fewest = int(np.ceil(similarity / (1 - similarity) - 1e-9))
    chance = [[comb(n, k) / 2**n for k in range(n + 1)] for n in range(41)]

    def over(total: int, more: int) -> float:
        return sum(c for k, c in enumerate(chance[more]) if total + 2 * k - more > 0)

    least, other = 0.0, 1.07 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    for union in range(2, 41):
        for both in range(int(np.ceil(similarity * union - 1e-9)), union):
            for a in range(union - both + 1):
                b, differ = union - both - a, 0.0
                for k, c in enumerate(chance[both]):
                    x, y = over(2 * k - both, a), over(2 * k - both, b)
                    differ += c * (x * (1 - y) + y * (1 - x))
                if min(a, b) + both == fewest:
                    least = max(least, differ)
                else:
                    other = max(other, differ)
    return fewest, int(fewest / similarity + 1e-9), max(least, other), other


def _cuts(width: int, top: int, differ: float) -> int:
    """Segments of ``width`` bits of which one matches, but for ``MISSED``: equal in ``top`` bits, in a ball of radius one in the others."""
    low = width - top
    found = (1 - differ) ** top * ((1 - differ) ** low + low * differ * (1 - differ) ** max(low - 1, 0))
    return int(np.ceil(np.log(MISSED) / np.log1p(-found)))


def _bits(h: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` bits of the SimHash of a set of hashes; bits beyond 64 are of the mixed hashes."""
    words = -(-count // 64)
    add = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255):  # what a byte can count
        z = h[at:at + 255, None] + add
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return (2 * ones > len(h))[:count]


PRINTS = [f"f{k}" for k in range(PRINT_WORDS)]
SKETCH = StructType([
    StructField("c1", LongType()), StructField("c2", LongType()), StructField("few", BooleanType()),
    StructField("segments", ArrayType(LongType())), *[StructField(f, LongType()) for f in PRINTS],
])


def sketch(width: int, top: int, words: int = 5, similarity: float = 0.8):
    """Column function: of a text's shingle set, a 128-bit hash, whether it is among the smallest sets, the segments of its
    fingerprint, ``width`` bits each, and the fingerprint's first words. No segments: no other set can be similar.
    """
    fewest, paired, least, other = _differing(similarity)
    cuts = {True: _cuts(width, top, least), False: _cuts(width, top, other)}
    place = 1 << np.arange(width, dtype=np.int64)

    @pandas_udf(SKETCH)
    def of(text: pd.Series) -> pd.DataFrame:
        c, f, few, segments = np.zeros((len(text), 2), np.int64), np.zeros((len(text), PRINT_WORDS), np.int64), [], []
        for k, t in enumerate(text):
            h = np.unique(shingle_hashes(t, words))
            c[k] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes(), SEED), np.int64)
            few.append(len(h) <= paired)
            if len(h) < fewest:
                segments.append(None)
                continue
            n = cuts[few[-1]]
            bits = _bits(h, max(64 * PRINT_WORDS, n * width))
            f[k] = np.packbits(bits[:64 * PRINT_WORDS], bitorder="little").view("<i8")
            segments.append(bits[:n * width].reshape(n, width) @ place)
        out = {"c1": c[:, 0], "c2": c[:, 1], "few": pd.Series(few, dtype=bool), "segments": pd.Series(segments, dtype=object)}
        return pd.DataFrame(out | {name: f[:, k] for k, name in enumerate(PRINTS)})

    return of


class _Links:
    """Pairs, thinned to a forest as they come: tiles of near copies link all with all."""

    def __init__(self):
        self.a, self.b, self.waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.waiting += len(a)
        if self.waiting > PAIRS:
            self.thin()

    def thin(self) -> pd.DataFrame:
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.waiting = [a], [b], 0
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def _by_tile(links):
    """``links`` of the rows of each tile, for rows sorted by tile; about ``BATCH_ROWS`` rows at once, or one tile."""

    def work(batches):
        held, rows_held, one = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows_held += len(batch)
            last = tuple(batch[TILE].iloc[-1])
            if rows_held < BATCH_ROWS or last == one:
                continue
            rows = pd.concat(held, ignore_index=True)
            open_ = (rows[TILE] == last).all(axis=1).to_numpy()
            if not open_.all():
                yield links(rows[~open_])
                rows = rows[open_].copy()
            held, rows_held, one = [rows], len(rows), last
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return work


def _candidates(width: int, most: list[tuple[int, int]]):
    """The pairs of a tile whose remaining ``width`` bits of a segment differ in at most one, verified on the fingerprint.

    ``most`` tells in how many bits its first word and all of it may differ; last, for two of the smallest sets.
    """

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        found = _Links()
        change = (rows[TILE] != rows[TILE].shift()).any(axis=1).to_numpy()
        rows = rows.iloc[np.lexsort([rows["low"], np.cumsum(change)])]
        tile, (i, j, low, side, node, few) = np.cumsum(change), (rows[c].to_numpy() for c in ("_i", "_j", "low", "_side", "node", "few"))
        prints = rows[PRINTS].to_numpy().view(np.uint64)
        first = np.ascontiguousarray(prints[:, 0])
        # a run of one value in one tile meets itself and the runs with one more bit
        runs = np.flatnonzero(np.append(True, (np.diff(tile) != 0) | (np.diff(low) != 0)))
        ends = np.append(runs[1:], len(rows))
        name = (tile[runs] << width) | low[runs]
        meets = [(np.arange(len(runs)), np.arange(len(runs)))]
        for bit in range(width):
            asks = np.flatnonzero(low[runs] & (1 << bit) == 0)
            want = name[asks] | (1 << bit)
            at = np.minimum(np.searchsorted(name, want), len(runs) - 1)
            meets.append((asks[name[at] == want], at[name[at] == want]))
        some_few = np.logical_or.reduceat(few, runs)
        for x, y in zip(*(np.concatenate(k).tolist() for k in zip(*meets))):
            if x == y and ends[x] - runs[x] == 1:
                continue
            bound = most[int(some_few[x] and some_few[y])][0]
            step = max(1, CELLS // int(ends[y] - runs[y]))
            for a in range(int(runs[x]), int(ends[x]), step):
                to, b = min(a + step, int(ends[x])), a if x == y else int(runs[y])
                p, q = np.nonzero(np.bitwise_count(first[a:to, None] ^ first[None, b:ends[y]]) <= bound)
                p, q = p + a, q + b
                # pairs inside a block are those of the block's own tile
                new = (p < q) & ((i[p] == j[p]) | (side[p] != side[q]))
                p, q = p[new], q[new]
                for k in range(0, len(p), PAIRS):
                    c, d = p[k:k + PAIRS], q[k:k + PAIRS]
                    apart = np.bitwise_count(prints[c] ^ prints[d])
                    both = (few[c] & few[d]).astype(int)
                    hit = (apart[:, 0] <= np.array(most)[both, 0]) & (apart.sum(1, dtype=np.int16) <= np.array(most)[both, 1])
                    found.add(node[c[hit]], node[d[hit]])
        return found.thin()

    return _by_tile(links)


def _layout(count: int) -> tuple[int, int]:
    """Bits of a segment, so that about ``SHARED`` of ``count`` fingerprints have a value, and how many of them tell tiles apart."""
    width = min(24, max(8, round(np.log2(max(count, 1) / SHARED))))
    top = 0
    while top < width and count / 2**top > 0.8 * PRINT_ROWS:
        top += 1
    return width, top


def _verified(similarity: float):
    """The pairs of a tile whose shingle sets have at least this Jaccard similarity, exactly."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        found = _Links()
        for (_, i, j), tile in rows.groupby(TILE, sort=False):
            node, side = tile["node"].to_numpy(), tile["_side"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in tile["set"]]
            size = np.array([len(x) for x in sets])
            _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            # hashes that one set has are in no intersection
            column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[at]
            row = np.repeat(np.arange(len(sets)), size)[column >= 0]
            column = column[column >= 0]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros((len(sets), len(sets)), np.int64)
            width = int((often > 1).sum())
            for low in range(0, width, 4096):
                lo, hi = np.searchsorted(column, [low, low + 4096])
                has = np.zeros((len(sets), min(4096, width - low)), np.float32)
                has[row[lo:hi], column[lo:hi] - low] = 1
                both += (has @ has.T).astype(np.int64)
            alike = np.triu(both / np.maximum(size[:, None] + size - both, 1) >= similarity, 1)
            if i != j:
                # pairs inside a block are those of the block's own tile
                alike &= side[:, None] != side
            x, y = np.nonzero(alike)
            found.add(node[x], node[y])
        return found.thin()

    return _by_tile(links)


LINKS = StructType([StructField(c, LongType()) for c in ("a", "b")])


def similar_groups(df: DataFrame, text: str = "text", key: tuple[str, str] = ("_k1", "_k2"), words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Add ``_group`` to the rows: texts linked by shingle sets of Jaccard similarity ``similarity`` or more share one.

    Rows alike in ``key`` have the same text. Candidates are found by multi-index hashing: fingerprints of several hundred
    bits are cut into segments, a Hamming ball of radius one is looked up within each one's range of values, and a match is
    verified on the fingerprint. Matches form loose groups, within which every pair is verified on the shingle sets themselves. No pair
    below the similarity is linked. A pair at the similarity is missed by all balls with probability ``MISSED`` at most.
    """
    spark = df.sparkSession
    width, top = _layout(df.count())
    low = width - top
    with batches_of(spark, BATCH_ROWS):
        rows = stored(df.withColumn("_s", sketch(width, top, words, similarity)(F.col(text))).select(*[c for c in df.columns if c != text], "_s.*"), "similar")
    of = [F.col(k).alias(f"_of{n}") for n, k in enumerate(key)]
    one = rows.select(*of, "c1", "c2", "few", "segments", *PRINTS).dropDuplicates(["c1", "c2"])
    classes = stored(one.withColumn("node", F.monotonically_increasing_id()), "similar")
    cut = classes.select("node", "few", *PRINTS, F.posexplode("segments").alias("_at", "_value"))
    spread = cut.select(
        (F.shiftleft(F.col("_at").cast("bigint"), 32) + F.shiftright("_value", low)).alias("bucket"),
        F.col("_value").bitwiseAND((1 << low) - 1).alias("low"), "node", "few", *PRINTS,
    )
    laid = tiles(spread, ["bucket"], "node", PRINT_ROWS, least=2).repartition(*TILE).sortWithinPartitions(*TILE)
    _, _, least, other = _differing(similarity)
    most = [
        tuple(int(np.ceil(n * p + LOOSE * np.sqrt(n * p * (1 - p)))) for n in (64, 64 * PRINT_WORDS)) for p in (other, least)
    ]
    with batches_of(spark, BATCH_ROWS * 8):
        loose = stored(laid.mapInPandas(_candidates(low, most), LINKS), "similar")
    loose = components(loose).join(classes.select("node", "_of0", "_of1"), "node").select(F.col("root").alias("bucket"), "node", "_of0", "_of1")
    texts = df.select(*key, text)
    found = loose.join(texts, (F.col("_of0") == F.col(key[0])) & (F.col("_of1") == F.col(key[1])))
    with batches_of(spark, BATCH_ROWS):
        sets = stored(found.select("bucket", "node", shingle_set(words)(F.col(text)).alias("set")).dropDuplicates(["node"]), "similar")
    sized = sets.select("bucket", "node", (F.octet_length("set") / 8.0).alias("_load"))
    laid = tiles(sized, ["bucket"], "node", SET_ROWS, least=2, block_load=SET_SHINGLES).join(sets.select("node", "set"), "node")
    laid = laid.select(*TILE, "_side", "node", "set").repartition(*TILE).sortWithinPartitions(*TILE)
    with batches_of(spark, BATCH_ROWS // 4):
        links = stored(laid.mapInPandas(_verified(similarity), LINKS), "similar")
    roots = stored(components(links), "components")
    known = classes.join(roots, "node", "left").select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.coalesce("root", "node").alias("_group"))
    own = [c for c in df.columns if c != text]
    return rows.join(known, (rows["c1"] == known["_c1"]) & (rows["c2"] == known["_c2"])).select(*own, "_group")


def keep_one(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows without near duplicates: of each group of similar texts the one with the smallest id stays.

    A null id comes last. Of rows alike in id and text one stays. Columns may have any names and stay as they are.
    """
    first, second = F.xxhash64(id, text), F.xxhash64(text, id, F.lit(1))
    keys = df.select(F.col(id).alias("_id"), first.alias("_k1"), second.alias("_k2"), F.col(text).alias("_text"))
    grouped = similar_groups(keys, "_text", ("_k1", "_k2"), words, similarity)
    best = grouped.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_k1", "_k2")).alias("best"))
    chosen = best.select(F.col("best._k1").alias("_c1"), F.col("best._k2").alias("_c2"))
    k1, k2, c1, c2, nth = free_names(df, "_k1", "_k2", "_c1", "_c2", "_nth")
    laid, chosen = df.withColumns({k1: first, k2: second}), chosen.toDF(c1, c2)
    left = laid.join(chosen, (F.col(k1) == F.col(c1)) & (F.col(k2) == F.col(c2)), "left_semi")
    once = F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1))
    return left.withColumn(nth, once).where(F.col(nth) == 1).select(*df.columns)
