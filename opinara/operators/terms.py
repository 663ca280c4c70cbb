"""Terms of cleaned texts as numbers: counts, weights in the row, sums over rows.

A task reads texts in Arrow batches and gives every distinct word of a batch a number once; words,
adjacent pairs, counts and weights are then array operations on numbers.  Nothing here shuffles
by document: counts leave a task summed by term, weights stay in their row, and sums over rows
leave a task as one row per term.

A fitted vocabulary is shipped to the tasks.  Its size is counted first; beyond ``SHIPPED`` terms
the relational forms in `operators.features` join it instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.operators.batches import in_slices, slices

SHIPPED = 500_000  # terms of a vocabulary that every task may hold
_HELD = 1_000_000  # counts that a task holds before it ships them
_NAMED = 100_000  # that are shipped at once


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of two or more letters of cleaned texts, with the row of each."""
    parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), "!", " "), " ")
    rows = np.asarray(pc.list_parent_indices(parts))
    flat = parts.flatten()
    long = pc.greater_equal(pc.binary_length(flat), 2)
    return rows[np.asarray(long)], flat.filter(long)


class _Counts:
    """Corpus and document frequencies of the words and pairs that a task has met."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, texts: pa.Array) -> None:
        rows, flat = _words(texts)
        if not len(flat):
            return
        local = flat.dictionary_encode()
        numbers = np.array([self.words.setdefault(w, len(self.words)) for w in local.dictionary.to_pylist()], dtype=np.int64)
        word = numbers[np.asarray(local.indices)]
        pair = np.flatnonzero(rows[1:] == rows[:-1])
        # A word is -1 - its number, a pair both numbers in one.
        keys = np.concatenate([-1 - word, (word[pair] << 31) | word[pair + 1]])
        row = np.concatenate([rows, rows[pair]])
        order = np.argsort(keys, kind="stable")  # rows of a key stay in order
        keys, row = keys[order], row[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))
        self.parts.append((keys[new], np.diff(new, append=len(keys)), np.add.reduceat(fresh.astype(np.int64), new)))
        self.held += len(new)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, tf, df = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[new], np.add.reduceat(tf[order], new), np.add.reduceat(df[order], new)

    def ship(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, tf, df = self.merged()
        words = pa.array(list(self.words), pa.string())
        self.__init__()  # before any names are made, which are made a part at a time
        for at in range(0, len(keys), _NAMED):
            key = keys[at : at + _NAMED]
            single = key < 0
            first = words.take(pa.array(np.where(single, -1 - key, key >> 31)))
            second = words.take(pa.array(np.where(single, 0, key & (2**31 - 1))))
            names = pc.if_else(pa.array(single), first, pc.binary_join_element_wise(first, second, " "))
            sums = [pa.array(x[at : at + _NAMED], pa.int64()) for x in (tf, df)]
            yield pa.RecordBatch.from_arrays([names, *sums], names=["term", "tf", "df"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        for part in slices(batch.column(0)):
            counts.add(part)
            if counts.held > _HELD:
                if len(counts.merged()[0]) > _HELD // 2:
                    yield from counts.ship()
                else:
                    counts.parts = [counts.merged()]
                    counts.held = len(counts.parts[0][0])
    yield from counts.ship()


def count_terms(docs: DataFrame, cleaned: str = "cleaned_text") -> DataFrame:
    """(term, tf, df): corpus and document frequency, summed inside each task first."""
    texts = docs.select(F.coalesce(F.col(cleaned), F.lit("")))
    parts = texts.mapInArrow(_count, "term string, tf long, df long")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


@dataclass(frozen=True)
class Vocabulary:
    """Terms in alphabetical order; a term's number is its place."""

    terms: pa.Array
    idf: np.ndarray
    words: pa.Array  # sorted words of all terms
    single: np.ndarray  # number of the term that a word is, or -1
    pairs: np.ndarray  # sorted keys of the pairs
    pair_terms: np.ndarray  # their numbers

    @classmethod
    def of(cls, terms: Sequence[str], idf: Sequence[float]) -> Vocabulary:
        order = sorted(range(len(terms)), key=terms.__getitem__)
        ordered = [terms[i] for i in order]
        words = sorted({w for t in ordered for w in t.split(" ")})
        place = {w: i for i, w in enumerate(words)}
        single = np.full(len(words) + 1, -1, dtype=np.int64)  # the last is no word
        keys, numbers = [], []
        for number, term in enumerate(ordered):
            a, _, b = term.partition(" ")
            if b:
                keys.append(place[a] * (len(words) + 1) + place[b])
                numbers.append(number)
            else:
                single[place[a]] = number
        by_key = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        return cls(
            pa.array(ordered, pa.string()),
            np.array([idf[i] for i in order], dtype=float),
            pa.array(words, pa.string()),
            single,
            np.array(keys, dtype=np.int64)[by_key],
            np.array(numbers, dtype=np.int64)[by_key],
        )

    def __len__(self) -> int:
        return len(self.terms)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the known terms, by row and term."""
        rows, flat = _words(texts)
        size = len(self.words)
        code = np.asarray(pc.index_in(flat, value_set=self.words).fill_null(size)).astype(np.int64)
        pair = np.flatnonzero(rows[1:] == rows[:-1])
        key = code[pair] * (size + 1) + code[pair + 1]
        at = np.searchsorted(self.pairs, key)
        hit = at < len(self.pairs)
        hit[hit] = self.pairs[at[hit]] == key[hit]
        term = np.concatenate([self.single[code], self.pair_terms[at[hit]]])
        row = np.concatenate([rows, rows[pair[hit]]])
        known = term >= 0
        both, count = np.unique(row[known].astype(np.int64) * max(len(self), 1) + term[known], return_counts=True)
        return both // max(len(self), 1), both % max(len(self), 1), count

    def weights(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count, weight): damped counts by idf, of unit length in each row."""
        row, term, count = self.counts(texts)
        raw = (1.0 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, raw * raw, minlength=len(texts)))
        return row, term, count, raw / norm[row]


def shipped(vocabulary: DataFrame) -> Vocabulary | None:
    """The vocabulary (term, idf) for the tasks, or None where it is too large to ship."""
    if vocabulary.count() > SHIPPED:
        return None
    rows = vocabulary.select("term", "idf").collect()
    return Vocabulary.of([r["term"] for r in rows], [r["idf"] for r in rows])


def _lists(size: int, row: np.ndarray, columns: dict[str, pa.Array]) -> pa.StructArray:
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=size))).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), c) for c in columns.values()], names=list(columns))


def term_vectors(docs: DataFrame, vocabulary: Vocabulary, cleaned: str = "cleaned_text") -> Column:
    """struct<terms, counts, weights> of a row: numbers of its known terms in order."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(texts: pa.Array) -> pa.Array:
        row, term, count, weight = shared.value.weights(texts)
        parts = {"terms": pa.array(term, pa.int32()), "counts": pa.array(count, pa.int64()), "weights": pa.array(weight, pa.float64())}
        return _lists(len(texts), row, parts)

    kind = "struct<terms: array<int>, counts: array<bigint>, weights: array<double>>"
    return F.arrow_udf(in_slices(vectors), kind)(F.coalesce(F.col(cleaned), F.lit("")))


def known_mass(docs: DataFrame, vocabulary: Vocabulary, cleaned: str = "cleaned_text") -> Column:
    """struct<n_known, idf_mass>: number of known terms, and the sum of their counts times idf."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def mass(texts: pa.Array) -> pa.Array:
        row, term, count = shared.value.counts(texts)
        known = np.bincount(row, minlength=len(texts)).astype(np.int64)
        sums = np.bincount(row, count * shared.value.idf[term], minlength=len(texts))
        return pa.StructArray.from_arrays([pa.array(known), pa.array(sums)], names=["n_known", "idf_mass"])

    return F.arrow_udf(in_slices(mass), "struct<n_known: bigint, idf_mass: double>")(F.coalesce(F.col(cleaned), F.lit("")))


def weight_rows(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "review_id", keep: Sequence[str] = (), cleaned: str = "cleaned_text") -> DataFrame:
    """(id, keep, term, weight): the weights in long form, shipped a few texts at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.coalesce(F.col(cleaned), F.lit("")).alias("_text"), id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, start = batch.columns[1:], 0
            for part in slices(batch.column(0)):
                row, term, _, weight = shared.value.weights(part)
                at = pa.array(row + start)
                pairs = [shared.value.terms.take(pa.array(term)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in others), *pairs], names=[id_col, *keep, "term", "weight"])
                start += len(part)

    made = T.StructType([*rows.schema.fields[1:], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return rows.mapInArrow(run, made)


def total_weights(docs: DataFrame, vocabulary: Vocabulary, cleaned: str = "cleaned_text") -> DataFrame:
    """(term, total) of the weights over all rows; a task ships one sum per term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value))
        for batch in batches:
            for part in slices(batch.column(0)):
                _, term, _, weight = shared.value.weights(part)
                total += np.bincount(term, weight, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([shared.value.terms.take(pa.array(met)), pa.array(total[met])], names=["term", "total"])

    parts = docs.select(F.coalesce(F.col(cleaned), F.lit(""))).mapInArrow(run, "term string, total double")
    return parts.groupBy("term").agg(F.sum("total").alias("total"))


def stacked(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the structs that `term_vectors` makes."""
    terms, weights = vectors.field("terms"), vectors.field("weights")
    return np.asarray(pc.list_parent_indices(terms)), np.asarray(terms.flatten()), np.asarray(weights.flatten())
