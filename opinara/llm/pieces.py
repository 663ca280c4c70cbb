"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass keeps, for each boundary of the text inside the last `longest` characters, the best
way to reach it: a piece and the boundary before it.  Whenever the backpointer paths of all
boundaries in that window meet in one boundary, no later character can change what lies before
it: those ids are committed and forgotten.  Memory is bounded by the longest piece and the
distance to the last meeting point, not by the text.

Both model types are read.  For unigram models a path's value is the sum of its piece scores.
For BPE models scores are merge ranks, and the right segmentation is the one that merging
would give: a piece may follow another only if merging the two pieces' characters gives back
exactly these two.  That leaves one valid way to reach each boundary, which is its Viterbi
survivor.  Characters outside the vocabulary become byte pieces (or the unknown id).

No piece spans a change from a letter to the blank mark, so every such place is a meeting
point; texts are cut there and words already seen in this batch are not encoded again.

Normalisation is that of identity models: blanks become the mark, one mark goes in front of a
text that isn't empty.  Decoding inverts it: `decode(encode(x)) == x` for every text without
the mark itself, which comes back as a blank.

Defined results: null and empty texts have no ids; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + size]
        i += size


@dataclass
class Model:
    """Pieces of a model file; ids are positions."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte
    bpe: bool
    prefix: bool

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (1, 4)}
        self.bytes_ = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        self.unknown = self.kinds.index(2)
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a blank mark after another character are not supported")
        if not all(c in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece itself")
        # Value of a character outside the vocabulary: below every piece.
        self.floor = min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == 1) - 10.0
        self._pairs: dict[int, bool] = {}
        self.spanned = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Finds all pieces that end at a character; for BPE only those that merging can give.
        self.finder = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if not self.bpe or self.merged(p) == [p]:
                self.finder.add_word(p, (len(p), i))
        self.finder.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives; used on pairs of pieces only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging keeps these two pieces side by side."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            pair = [self.pieces[left], self.pieces[right]]
            known = self._pairs[key] = self.merged("".join(pair)) == pair
        return known

    def stream(self, text: str) -> Iterator[tuple[int, str]]:
        """(id, piece) in order, committed while the text is read once from left to right.

        A character outside the vocabulary has the id -1.
        """
        bpe, pairs, scores, longest = self.bpe, self._pairs, self.scores, self.longest
        base = 0  # last committed boundary; the lists below start there
        value: list[float | None] = [0.0]  # of each boundary; None: not reached yet
        back: list[int] = [0]
        ends: list[int] = [-1]  # last piece on the way to it
        for end, (size, k) in chain(self.finder.iter(text), ((len(text), (0, -1)),)):
            at = end + 1 - base
            while len(value) < at:  # no piece ends here: a character outside the vocabulary
                value.append(value[-1] + self.floor)
                back.append(len(back) - 1)
                ends.append(-1)
            if not size:
                break
            if len(value) == at:
                if at > 2 * longest and at % longest == 1:
                    meet = self._meeting(back, value, at - 1)
                    if meet:
                        yield from self._path(back, ends, meet, text, base)
                        base, at = base + meet, at - meet
                        value, ends = value[meet:], ends[meet:]
                        back = [max(x - meet, 0) for x in back[meet:]]
                value.append(None)
                back.append(-1)
                ends.append(-1)
            start = at - size
            if start < 0 or value[start] is None:
                continue
            if bpe:
                left = ends[start]
                if value[at] is None and (left < 0 or (pairs.get(left << 32 | k) or self.follows(left, k))):
                    value[at], back[at], ends[at] = 0.0, start, k
            else:
                gain = value[start] + scores[k]
                if value[at] is None or gain > value[at]:
                    value[at], back[at], ends[at] = gain, start, k
        yield from self._path(back, ends, len(text) - base, text, base)

    def short(self, text: str) -> list[tuple[int, str]]:
        """`stream` for a BPE text too short to have a meeting point before its end."""
        pairs = self._pairs
        ends: list[int | None] = [-1] + [None] * len(text)
        back = [0] * len(ends)
        for end, (size, k) in self.finder.iter(text):
            at = end + 1
            if ends[at] is None:
                left = ends[at - size]
                if left is None:  # after characters outside the vocabulary
                    self._fill(ends, back, at - size)
                    left = -1
                if left < 0 or pairs.get(left << 32 | k) or self.follows(left, k):
                    ends[at], back[at] = k, at - size
        if ends[-1] is None:
            self._fill(ends, back, len(text))
        return self._path(back, ends, len(text), text, 0)

    @staticmethod
    def _fill(ends: list[int | None], back: list[int], at: int) -> None:
        while ends[at] is None:
            ends[at], back[at] = -1, at - 1
            at -= 1

    def _meeting(self, back: list[int], value: list[float | None], n: int) -> int:
        """The boundary where the paths of all boundaries that a later piece can follow meet."""
        alive = {i for i in range(n - self.longest + 1, n + 1) if value[i] is not None}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(back[top])
        return alive.pop()

    @staticmethod
    def _path(back: list[int], ends: list[int], at: int, text: str, base: int) -> list[tuple[int, str]]:
        out = []
        while at > 0:
            out.append((ends[at], text[base + back[at] : base + at]))
            at = back[at]
        return out[::-1]

    def word_ids(self, word: str) -> list[int]:
        out = []
        for k, p in self.short(word) if self.bpe and len(word) <= 2 * self.longest else self.stream(word):
            if k >= 0:
                out.append(k)
            elif self.bytes_:
                out += [self.bytes_[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def words(self, text: str) -> list[str]:
        """The normalised text, cut before each mark that follows another character."""
        marked = text.replace(" ", MARK)
        if self.prefix:
            marked = MARK + marked
        parts = marked.split(MARK)
        out, marks = [parts[0]] if parts[0] else [], 0
        for part in parts[1:]:
            marks += 1
            if part:
                out.append(MARK * marks + part)
                marks = 0
        if marks:
            out.append(MARK * marks)
        return out

    def decode(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if self.kinds[i] != 3:
                out.append(self.pieces[i])
        if held:
            out.append(held.decode(errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, bpe, prefix = [], [], [], False, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), dtype="<f4")[0]))
            kinds.append(own.get(3, 1))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            rules = dict(_fields(value))
            prefix = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("only identity normalisation that keeps blanks is supported")
    return Model(pieces, scores, kinds, bpe, prefix)


class Known:
    """Ids of words seen lately: two generations of at most CACHE words each."""

    def __init__(self, model: Model):
        self.model = model
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def new(self, word: str) -> tuple[int, ...]:
        # No piece spans these two characters: the word's end is a meeting point as well.
        if len(word) > 2 and word[-1] in ".,!?;:" and word[-2:] not in self.model.spanned:
            return (*next(self.ids([word[:-1]])), *next(self.ids([word[-1]])))
        return tuple(self.model.word_ids(word))

    def ids(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        for w in words:
            found = self.young.get(w)
            if found is None:
                found = self.old.get(w)
                if found is None:
                    found = self.new(w)
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                if len(w) <= 64:
                    self.young[w] = found
            yield found


def encode_batch(known: Known, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text."""
    return [
        np.fromiter(chain.from_iterable(known.ids(known.model.words(t) if t else [])), dtype=np.int32) for t in texts
    ]


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        known = Known(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = part.column("_text").to_pylist()
                ids = encode_batch(known, texts)
                edge = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                same = [model.decode(x.tolist()) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                digest = [hashlib.md5(x.astype("<i4").tobytes()).hexdigest() for x in ids]
                columns = [part.column("_id"), pa.array(np.diff(edge).astype(np.int64)), pa.array(digest), pa.array(same)]
                names = ["_id", "n_ids", "ids_md5", "round_trip"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(ids) if ids else [], pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_ids, ids_md5, round_trip, ids): `round_trip` tells that decoding gives the text back."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, n_ids long, ids_md5 string, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_encode(path, with_ids), schema).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows; null ids give an empty text."""
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
