"""Text steps as native column expressions (no Python workers on this path)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.constants import NEGATORS, SERVING_NEGATORS, STOP_WORDS

# Blanks other than the space character, as a whitespace split of Unicode text sees them.
_OTHER = (
    r"\t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
BLANKS = " " + _OTHER
# The same classes behind two range tests that reject ordinary letters at once.
_BLANK = rf"[[^\x21-\x84\xA1-\x{{167F}}]&&[{BLANKS}]]"
_ODD_BLANK = rf"[[^\x20-\x84\xA1-\x{{167F}}]&&[{_OTHER}]]"
IRREGULAR_BLANKS = f" {_BLANK}+|{_ODD_BLANK}{_BLANK}*"
# In single-spaced text: a token with a capital and no lower- or title-case letter.
UPPER_TOKEN = (
    r"(?=[^ a-z])(?<![^ ])[^ \p{Ll}\p{Lt}\p{Lu}]*+\p{Lu}[^ \p{Ll}\p{Lt}]*+(?![^ ])"
)

# Characters removed by each cleaning mode, and what replaces them.
CLEAN_MODES = {
    "keep_exclaim": (f"[^a-zA-Z!{BLANKS}]+", ""),
    "letters": (f"[^a-zA-Z{BLANKS}]+", ""),
    "spaced": (f"[^a-zA-Z{BLANKS}]+", " "),
}
# The same for lower-cased, single-spaced text.
_COLLAPSED_MODES = {
    "keep_exclaim": ("[^a-z !]+", ""),
    "letters": ("[^a-z ]+", ""),
    "spaced": ("[^a-z ]+", " "),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fill_text(text: Column | str) -> Column:
    """Null text becomes the empty string."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit(""))


def collapse_blanks(text: Column) -> Column:
    """Single-spaced text; only irregular blanks are rewritten."""
    return F.btrim(F.regexp_replace(text, IRREGULAR_BLANKS, " "))


def tokens(text: Column, collapsed: bool = False) -> Column:
    """Whitespace tokens without empties; ``collapsed`` marks text that is single-spaced."""
    single = text if collapsed else collapse_blanks(text)
    return F.array_remove(F.split(single, " "), "")


def join_tokens(words: Column) -> Column:
    return F.array_join(words, " ")


def expand_contractions(text: Column) -> Column:
    return F.replace(text, F.lit("n't"), F.lit(" not"))


def mark_negation(
    text: Column, negators: Iterable[str] = NEGATORS, window: int = 3
) -> Column:
    """Prefix ``NOT_`` to each non-negator within ``window`` tokens after a negator.

    Because a negator restarts the window, a token is marked exactly when one of the
    ``window`` tokens before it is a negator, so no running state is needed.  Texts
    without any negator skip the array work.
    """
    words = sorted(negators)
    first = "".join(sorted({w[0] for w in words}))
    has_negator = f"(?i)(?=[{first}])(?<![^ ])(?:{'|'.join(words)})(?![^ ])"

    def mark(ws: Column) -> Column:
        flags = F.transform(ws, lambda w: F.lower(w).isin(*words))

        def apply(neg: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                near = F.lit(False)
                for distance in range(1, window + 1):
                    near = near | F.coalesce(F.get(neg, i - distance), F.lit(False))
                return F.when(F.get(neg, i), w).when(near, F.concat(F.lit("NOT_"), w)).otherwise(w)

            return F.array_join(F.transform(ws, one), " ")

        return let(flags, apply)

    return let(
        collapse_blanks(text),
        lambda s: F.when(s.rlike(has_negator), let(tokens(s, collapsed=True), mark)).otherwise(s),
    )


def stop_list(keep_words: Iterable[str] = (), base: Iterable[str] = STOP_WORDS) -> list[str]:
    kept = set(keep_words)
    return [w for w in base if w not in kept]


def regex_strip(text: Column, mode: str = "keep_exclaim") -> Column:
    pattern, replacement = CLEAN_MODES[mode]
    return F.regexp_replace(text, pattern, replacement)


def remove_stopwords(words: Column, stop_words: Iterable[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def clean_tokens(
    text: Column,
    keep_words: Iterable[str] = NEGATORS,
    mode: str = "keep_exclaim",
    stop_words: Iterable[str] = STOP_WORDS,
    collapsed: bool = False,
) -> Column:
    single = text if collapsed else collapse_blanks(text)
    pattern, replacement = _COLLAPSED_MODES[mode]
    words = tokens(F.regexp_replace(F.lower(single), pattern, replacement), collapsed=True)
    return remove_stopwords(words, stop_list(keep_words, stop_words))


def clean_text(
    text: Column,
    keep_words: Iterable[str] = NEGATORS,
    mode: str = "keep_exclaim",
    stop_words: Iterable[str] = STOP_WORDS,
    collapsed: bool = False,
) -> Column:
    """Lower-case, strip, tokenise, drop stop words, join."""
    return join_tokens(clean_tokens(text, keep_words, mode, stop_words, collapsed))


def prepare_training(text: Column) -> Column:
    """Negation-marked text of the training profile."""
    return mark_negation(expand_contractions(fill_text(text)), NEGATORS, 3)


def prepare_serving(text: Column) -> Column:
    """Negation-marked text of the serving profile (window 2, no contraction step)."""
    return mark_negation(fill_text(text), SERVING_NEGATORS, 2)


def char_length(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column, collapsed: bool = False) -> Column:
    return F.size(tokens(text, collapsed))


def exclamation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def uppercase_count(text: Column, collapsed: bool = False) -> Column:
    single = text if collapsed else collapse_blanks(text)
    return F.regexp_count(single, F.lit(UPPER_TOKEN))


def contains_question(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("?")), F.lit(False))


def strip_or_null(text: Column) -> Column:
    return F.nullif(collapse_edges(text), F.lit(""))


def collapse_edges(text: Column) -> Column:
    """Remove blanks at both ends."""
    return F.regexp_replace(text, f"^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")


def preview(text: Column, chars: int = 200) -> Column:
    """A display column; never used as input of another step."""
    return F.substring(text, 1, chars)


def terms(cleaned: Column) -> Column:
    """Words of two or more letters, followed by adjacent pairs, of a cleaned text.

    Cleaned text holds letters, blanks and ``!`` only, so word borders are blanks and ``!``.
    """

    def both(ws: Column) -> Column:
        pairs = F.zip_with(
            ws,
            F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(ws, F.slice(pairs, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))))

    words = F.split(F.replace(cleaned, F.lit("!"), F.lit(" ")), " ")
    return let(F.filter(words, lambda w: F.length(w) >= 2), both)


def term_counts(all_terms: Column) -> Column:
    """array<struct<term,tf>> of one document: run lengths of the sorted terms, in the row."""

    def count_runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda s, j: F.struct(
                    F.get(ordered, s).alias("term"),
                    (F.coalesce(F.get(st, j + 1), n) - s).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(all_terms), count_runs)
