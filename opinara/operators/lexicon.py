"""Lexicon scoring: token stream joined with a (token, valence, polarity) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.session import lookup_join

# Anything but letters and digits is trimmed from token edges, here over single-spaced text.
# A match starts only where a run of such characters starts and never backtracks, so long
# runs of symbols cost linear time.
EDGE_RUNS = r"(?<![^\p{L}\p{N} ])(?:(?<![^ ])[^\p{L}\p{N} ]++|[^\p{L}\p{N} ]++(?![^ ]))"
EDGES = r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"


def lexicon_token(word: Column) -> Column:
    """Lookup form of one token."""
    return F.lower(F.regexp_replace(word, EDGES, ""))


def lookup_text(single: Column) -> Column:
    """Lookup form of all tokens of a single-spaced text; token positions are kept."""
    return F.regexp_replace(F.lower(single), EDGE_RUNS, "")


def _words(lexicon: DataFrame, bounded: bool) -> list[str] | None:
    """The words of a lexicon of fixed size, so that other tokens can be left where they are."""
    return sorted({r["token"] for r in lexicon.select("token").collect()}) if bounded else None


def token_stream(
    df: DataFrame, text_col: str, id_col: str = "review_id", keep: Sequence[str] = (), words: list[str] | None = None
) -> DataFrame:
    """(id, kept narrow columns, n_words, token); reviews without tokens keep one null row.

    Where ``words`` are given, only those tokens leave the row.
    """
    single = df.select(id_col, *keep, T.collapse_blanks(T.fill_text(text_col)).alias("_single"))
    # The count is finished before the explode, so no text travels with the tokens.
    per_review = single.select(
        id_col,
        *keep,
        T.word_count(F.col("_single"), collapsed=True).alias("n_words"),
        _among(T.tokens(lookup_text(F.col("_single")), collapsed=True), words).alias("_tokens"),
    )
    return per_review.select(id_col, *keep, "n_words", F.explode_outer("_tokens").alias("token"))


def _among(tokens: Column, words: list[str] | None) -> Column:
    return tokens if words is None else F.filter(tokens, lambda w: w.isin(*words))


def lexicon_hits(df: DataFrame, lexicon: DataFrame, text_col: str, id_col: str = "review_id", bounded: bool = False) -> DataFrame:
    """One row per lexicon word occurrence."""
    return lookup_join(
        token_stream(df, text_col, id_col, words=_words(lexicon, bounded)), lexicon, "token", "inner", bounded=bounded
    )


def lexicon_scores(
    df: DataFrame,
    lexicon: DataFrame,
    text_col: str,
    id_col: str = "review_id",
    keep: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """(id, keep, n_words, n_hits, valence_sum, compound, polarity) for every review.

    The text itself never enters a shuffle: tokens of a review are counted where they
    were read (partial aggregation) and one narrow row per review is exchanged.  A kept
    column is carried next to each token, so only narrow columns belong in ``keep``.
    """
    stream = token_stream(df, text_col, id_col, keep, _words(lexicon, bounded))
    stream = lookup_join(stream, lexicon, "token", bounded=bounded)
    return (
        stream.groupBy(id_col)
        .agg(
            *[F.first(c).alias(c) for c in keep],
            F.first("n_words").alias("n_words"),
            F.count("valence").cast("int").alias("n_hits"),
            F.coalesce(F.sum("valence"), F.lit(0.0)).alias("valence_sum"),
            F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"),
        )
        .withColumn("compound", S.compound(F.col("valence_sum")))
    )


def predict_from_scores(scored: DataFrame, inclusive: bool = False) -> DataFrame:
    """Labels of both lexicon scores."""
    return scored.withColumn(
        "vader", S.threshold_label(F.col("compound"), C.COMPOUND_THRESHOLD, inclusive)
    ).withColumn("textblob", S.threshold_label(F.col("polarity"), 0.0))


def _modifier(word: Column, mixed_case: Column) -> Column:
    """Signed strength of an intensity word; capitals add to it in mixed-case text."""
    low = lexicon_token(word)
    caps = F.when(mixed_case & _is_upper(word), C.CAPS_BOOST).otherwise(0.0)
    return (
        F.when(low.isin(*C.BOOSTERS_UP), C.BOOST + caps)
        .when(low.isin(*C.BOOSTERS_DOWN), -C.BOOST + caps)
        .otherwise(F.lit(0.0))
    )


def _is_upper(word: Column) -> Column:
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"[\p{Ll}\p{Lt}]")


def rule_scores(
    df: DataFrame,
    lexicon: DataFrame,
    text_col: str,
    id_col: str = "review_id",
    bounded: bool = False,
) -> DataFrame:
    """(id, n_hits, compound) with the valence rules.

    Rules: intensity words up to three tokens before (with decay), negators up to three
    tokens before, capitals in mixed-case text, the clause after "but", and exclamation
    marks.  The three preceding words travel with each token, so no window over the token
    stream is needed, and rules are evaluated on lexicon hits only.
    """
    single = df.select(id_col, T.collapse_blanks(T.fill_text(text_col)).alias("text"))
    per_review = single.select(
        id_col,
        F.split("text", " ").alias("ws"),
        F.split(lookup_text(F.col("text")), " ").alias("keys"),
        F.least(T.exclamation_count(F.col("text")), F.lit(C.EXCLAIM_MAX)).alias("exclaims"),
        T.uppercase_count(F.col("text"), collapsed=True).alias("n_upper"),
        F.split(F.lower("text"), " ").alias("low"),
    )

    words = _words(lexicon, bounded)
    placed = F.transform("keys", lambda key, i: F.struct(key.alias("token"), i.alias("pos")))
    if words is not None:
        placed = F.filter(placed, lambda x: x["token"].isin(*words))

    def with_context(x: Column) -> Column:
        i = x["pos"]
        return F.struct(
            i.alias("pos"),
            x["token"].alias("token"),
            F.get("ws", i).alias("word"),
            F.get("ws", i - 1).alias("w1"),
            F.get("ws", i - 2).alias("w2"),
            F.get("ws", i - 3).alias("w3"),
        )

    # Outer, because an inner explode adds a filter that would evaluate the contexts twice.
    stream = (
        per_review.select(
            id_col,
            "exclaims",
            ((F.col("n_upper") > 0) & (F.col("n_upper") < F.size("ws"))).alias("mixed_case"),
            (F.nullif(F.array_position("low", "but"), F.lit(0)) - 1).alias("but_at"),
            F.transform(placed, with_context).alias("contexts"),
        )
        .select(id_col, "exclaims", "mixed_case", "but_at", F.explode_outer("contexts").alias("c"))
        .select(id_col, "exclaims", "mixed_case", "but_at", "c.*")
    )
    hits = lookup_join(stream, lexicon.select("token", "valence"), "token", bounded=bounded)

    sign = F.when(F.col("value") > 0, 1.0).otherwise(-1.0)
    loud = F.col("mixed_case") & _is_upper(F.col("word"))
    valued = hits.withColumn("value", F.col("valence")).withColumn(
        "value", F.col("value") + F.when(loud, sign * C.CAPS_BOOST).otherwise(0.0)
    )
    for name, decay in zip(("w1", "w2", "w3"), C.BOOST_DECAY):
        word = F.col(name)
        step = F.coalesce(_modifier(word, F.col("mixed_case")), F.lit(0.0)) * sign * decay
        negated = F.coalesce(lexicon_token(word).isin(*C.RULE_NEGATORS), F.lit(False))
        valued = valued.withColumn(
            "value", (F.col("value") + step) * F.when(negated, C.NEGATION_FACTOR).otherwise(1.0)
        )
    clause = (
        F.when(F.col("pos") < F.col("but_at"), C.BUT_BEFORE)
        .when(F.col("pos") > F.col("but_at"), C.BUT_AFTER)
        .otherwise(1.0)
    )
    contribution = F.col("value") * clause
    total = F.coalesce(F.sum(contribution), F.lit(0.0))
    emphasis = F.first("exclaims") * F.lit(C.EXCLAIM_STEP)
    return (
        valued.groupBy(id_col)
        .agg(F.count("valence").cast("int").alias("n_hits"), total.alias("total"), emphasis.alias("emphasis"))
        .withColumn(
            "amplified",
            F.when(F.col("total") > 0, F.col("total") + F.col("emphasis"))
            .when(F.col("total") < 0, F.col("total") - F.col("emphasis"))
            .otherwise(F.lit(0.0)),
        )
        .select(id_col, "n_hits", S.compound(F.col("amplified")).alias("compound"))
    )
