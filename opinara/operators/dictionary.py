"""Cleaning by a dictionary of distinct tokens.

A batch of texts becomes one array of numbers, one for each token, and a dictionary of the
batch's distinct tokens.  Lower-casing, stripping, stop words and the letter tests are done once
per distinct token; marking after negators and the choice of the cleaned form are array
operations on the numbers.  Results equal those of the column functions in `functions.text`.

Defined results: null texts are empty; a text without tokens cleans to the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.constants import NEGATORS, STOP_WORDS
from opinara.functions.text import stop_list

_TOKENS = 250_000  # that are laid out at once, about
_STRIP = {"keep_exclaim": re.compile("[^a-z!]+"), "letters": re.compile("[^a-z]+")}


def is_upper(token: str) -> bool:
    """A capital and no lower- or title-case letter."""
    if token.isascii():
        return token.isupper()
    kinds = {unicodedata.category(c) for c in token}
    return "Lu" in kinds and not kinds & {"Ll", "Lt"}


class Cleaner:
    """Cleaned text and counts of raw texts."""

    def __init__(self, keep_words: Iterable[str] = NEGATORS, mode: str = "keep_exclaim", negators: Iterable[str] = NEGATORS, window: int = 3, expand: bool = True) -> None:
        self.strip, self.stops = _STRIP[mode], set(stop_list(keep_words, STOP_WORDS))
        self.negators, self.window, self.expand = set(negators), window, expand

    def __call__(self, texts: pa.Array) -> pa.StructArray:
        parts, held, size = [], [], 0
        for value in texts:
            text = value.as_py() or ""
            held.append((text.replace("n't", " not") if self.expand else text).split())
            size += len(held[-1])
            if size >= _TOKENS:
                parts.append(self._clean(held))
                held, size = [], 0
        parts.append(self._clean(held))
        return pa.concat_arrays(parts)

    def _clean(self, lists: list[list[str]]) -> pa.StructArray:
        # Factories that hold no dictionary: a cycle would keep every layout until a full collection.
        number: dict[str, int] = defaultdict(count().__next__)
        size = np.array([len(ws) for ws in lists], dtype=np.int64)
        token = np.fromiter((number[w] for ws in lists for w in ws), dtype=np.int64, count=int(size.sum()))
        row = np.repeat(np.arange(len(lists)), size)

        # Once per distinct token: as it is, and marked after a negator.
        form: dict[str, int] = defaultdict(count().__next__)
        plain, marked, negates, upper, bangs = [], [], [], [], []
        for w in number:
            low = w.lower()
            short = self.strip.sub("", low)
            plain.append(form[short] if short and short not in self.stops else -1)
            marked.append(form["not" + short] if "not" + short not in self.stops else -1)
            negates.append(low in self.negators)
            upper.append((is_upper(w), is_upper("NOT_" + w)))
            bangs.append(w.count("!"))

        flag = np.array(negates, dtype=bool)[token]
        near = np.zeros(len(token), dtype=bool)
        for d in range(1, self.window + 1):
            near[d:] |= flag[:-d] & (row[d:] == row[:-d])
        near &= ~flag
        chosen = np.where(near, np.array(marked, dtype=np.int64)[token], np.array(plain, dtype=np.int64)[token])
        keep = chosen >= 0
        ends = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(lists)))).astype(np.int32)
        words = pa.array(list(form), pa.string()).take(pa.array(chosen[keep]))
        cleaned = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), " ")
        capital = np.array(upper, dtype=np.int64).reshape(-1, 2)[token, near.astype(np.int64)]
        counts = [np.bincount(row, x, minlength=len(lists)).astype(np.int32) for x in (np.array(bangs, dtype=np.int64)[token], capital)]
        return pa.StructArray.from_arrays([cleaned, *map(pa.array, counts)], names=["cleaned", "exclamation_count", "uppercase_count"])


def clean(text: Column, cleaner: Cleaner | None = None) -> Column:
    """struct<cleaned, exclamation_count, uppercase_count> of a text column: cleaned text without
    lemmas, and the two counts over the marked text."""
    run = cleaner or Cleaner()
    kind = "struct<cleaned: string, exclamation_count: int, uppercase_count: int>"
    return F.arrow_udf(lambda texts: run(texts), kind)(text.cast("string"))
