"""SentencePiece encoding by streaming Viterbi, and decoding.

Every position of the text keeps one backpointer: the last piece of the best
segmentation that ends there. No piece is longer than L characters, so a new
position only looks back L positions. Once the backpointer paths of the last L
positions meet in one boundary, nothing that follows can change what lies before
it; the ids up to there are given out and forgotten.

The best segmentation depends on the kind of model. In a unigram model it has the
highest sum of piece scores. In a BPE model (as the public 32k file is) it is the one
that merging by score yields; a segmentation is that one exactly if each two
neighbouring pieces, merged by themselves, stay what they are, so exactly one
piece survives at each position.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNKNOWN_PENALTY = 10.0  # fixed value of the format: an unknown character scores this much below the worst piece
WORDS_KEPT = 400_000
SLICE_ROWS = 1024
GROUP_CHARS = 1 << 22
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """Field number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class Model:
    """Vocabulary, scores and normalisation flags of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.types = [], [], []
        trainer = normalizer = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are encoded")
        if normalizer.get(2) or normalizer.get(4, 1) or USER_DEFINED in self.types or trainer.get(24, 0):
            raise ValueError("models with a character map, space removal, user-defined pieces or suffix spaces are not encoded")
        self.prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        # pieces that hold a space after another character would tie words together
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # lengths of the pieces that end in two given characters, longest first
        self.tails: dict = {}
        for p in sorted(self.ids, key=len, reverse=True):
            if len(p) > 1 and len(p) not in (known := self.tails.setdefault(p[-2:], [])):
                known.append(len(p))
        self._pairs: dict = {}
        self._words: dict = {}

    # --- encoding ---

    def merged(self, text: str) -> list[str]:
        """Merge neighbours into the piece of the highest score, leftmost first, until none is left."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, a: str, b: str) -> bool:
        """Whether two neighbours (none before the first piece) stay apart when merged by themselves."""
        if len(self._pairs) > WORDS_KEPT:
            self._pairs.clear()
        fits = self._pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return fits

    def _extend(self, text: str, base: int, last: list[str], best: list[float], to: int) -> None:
        """Add the backpointers of the positions up to ``to``; ``last[0]`` is position ``base``."""
        if self.kind == BPE:
            ids, fits, tails = self.ids, self._pairs.get, self.tails.get
            for end in range(base + len(last), to + 1):
                piece, room = text[end - 1], end - base
                for n in tails(text[end - 2:end], ()):
                    if n <= room:
                        longer = text[end - n:end]
                        if longer in ids:
                            before = last[room - n]
                            fit = fits((before, longer))
                            if fit or (fit is None and self._stays(before, longer)):
                                piece = longer
                                break
                last.append(piece)
            return
        ids, scores = self.ids, self.scores
        for end in range(base + len(last), to + 1):
            piece, top = text[end - 1], best[-1] + self.worst
            for start in range(max(base, end - self.longest), end):
                i = ids.get(text[start:end])
                if i is not None and best[start - base] + scores[i] > top:
                    top, piece = best[start - base] + scores[i], text[start:end]
            best.append(top)
            last.append(piece)

    def _viterbi(self, text: str):
        """Give out the pieces of a text, holding a window of it."""
        last, best, base, stride = [""], [0.0], 0, 8 * self.longest
        end = 0
        while end < len(text):
            end = min(len(text), end + stride)
            self._extend(text, base, last, best, end)
            cut = self._boundary(last)
            yield from self._walk(last, cut)
            # the piece before the boundary stays known, for the pairs that follow
            base, last, best = base + cut, last[cut:], best[cut:]
        yield from self._walk(last, len(last) - 1)

    def _boundary(self, last: list[str]) -> int:
        """The last boundary that the paths of all live positions share."""
        live = range(max(0, len(last) - self.longest), len(last))
        shared = None
        for at in live:
            path = set()
            while at > 0:
                path.add(at)
                at -= len(last[at])
            shared = path if shared is None else shared & path
        return max(shared, default=0)

    @staticmethod
    def _walk(last: list[str], at: int) -> list[str]:
        path = []
        while at > 0:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def _to_ids(self, pieces) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # a run of unknown characters is one piece
        return out

    def _learn(self, words: set[str]) -> None:
        """Encode words in sorted order, so that each starts from the positions it shares with the one before."""
        before, last, best = "", [""], [0.0]
        known, ids, extend = self._words, self.ids, self._extend
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del last[same + 1:], best[same + 1:]
            at = len(word)
            extend(word, 0, last, best, at)
            before, path = word, []
            while at:
                piece = last[at]
                path.append(ids.get(piece, -1))
                at -= len(piece)
            if -1 in path:
                path = self._to_ids(self._walk(last, len(word)))[::-1]
            known[word] = array("i", path[::-1]).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text. Words are encoded once for each group of GROUP_CHARS characters and kept for later ones."""
        out: list = []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP_CHARS:
                text = texts[at]
                at += 1
                if text is not None:
                    text = (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""
                    size += len(text)
                group.append(text)
            # no piece joins words, so all paths meet at their ends
            split = WORD.findall if self.splits else lambda t: [t] * bool(t)
            short, known = 8 * self.longest, self._words
            if len(known) > WORDS_KEPT:
                known.clear()
            missing: set[str] = set()
            for text in group:
                if text:
                    missing.update(split(text))
            self._learn({w for w in missing.difference(known) if len(w) <= short})
            for text in group:
                if text is None:
                    out.append(None)
                    continue
                words = split(text)
                found = [known.get(w) for w in words]
                if None in found:
                    for k in [k for k, ids in enumerate(found) if ids is None]:
                        found[k] = np.array(self._to_ids(self._viterbi(words[k])), np.int32).tobytes()
                out.append(np.frombuffer(b"".join(found), np.int32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    # --- decoding ---

    def decode(self, ids) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if self.types[i] == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.types[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.types[i] != CONTROL:
                out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def model(path: str) -> Model:
    return Model(path)


def encode(text: Column, path: str | None = None) -> Column:
    """Ids of each text, with the model file at ``path`` on every executor. Null stays null, an empty text has no ids."""
    path = path or model_path()

    @pandas_udf(ArrayType(IntegerType()))
    def of(text: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series(m.encode_all(text.tolist()), dtype=object)

    return of(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of each id array. U+2581 in a text is read back as a space, as the format has it."""
    path = path or model_path()

    @pandas_udf(StringType())
    def of(ids: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series([None if x is None else m.decode(x.tolist()) for x in ids], dtype=object)

    return of(ids)


def tokenized(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The rows with ``ids``, ``n_tokens`` and ``round_trip`` (whether the ids decode to the text) in place of ``text``.

    Arrow batches are worked off in slices, so that neither ids nor decoded texts of a whole batch are held at once.
    """
    path = path or model_path()
    keep = [f for f in df.schema.fields if f.name not in (text, "ids", "n_tokens", "round_trip")]
    schema = StructType([*keep, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("round_trip", BooleanType())])

    def work(batches):
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(text).to_pylist()
                ids = m.encode_all(texts)
                same = [None if x is None else m.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in keep], pa.array(ids, pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array(same, pa.bool_())],
                    names=schema.names,
                )

    return df.select(*[f.name for f in keep], text).mapInArrow(work, schema)
