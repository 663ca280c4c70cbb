"""Lemma table by noun suffix rules checked against the corpus vocabulary, and its use."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.operators.batches import in_slices, slices
from opinara.session import checkpointed, lookup_join

SHIPPED = 32 << 20  # bytes of a lemma table that every task may hold


def _split(texts: pa.Array) -> pa.Array:
    """Lists of the tokens of single-spaced texts; an empty text has none."""
    lists = pc.split_pattern(texts.cast(pa.string()), " ")
    return pc.if_else(pc.equal(texts, ""), pa.scalar([], lists.type), lists)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different tokens of each batch."""
    for batch in batches:
        parts = []
        for column in slices(batch.column(0)):
            lists = column if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else _split(column)
            parts.append(lists.flatten().unique())
        found = pa.concat_arrays(parts).unique()
        yield pa.RecordBatch.from_arrays([found.filter(found.is_valid())], names=["token"])


def vocabulary(df: DataFrame, tokens_col: str) -> DataFrame:
    """Tokens of lists or single-spaced texts; repeated ones collapse batch by batch, before they
    are rows, and may be met once per batch."""
    return df.select(tokens_col).mapInArrow(_distinct, "token string")


def lemma_map(vocab: DataFrame) -> DataFrame:
    """(token, lemma) for tokens whose rule result is itself a known token.

    The shortest candidate wins, then the alphabetically first.  The vocabulary is read once: a
    token meets what the rules make of others under one key, at most one row per rule.
    """
    made = [
        F.when(
            F.endswith(F.col("token"), F.lit(ending)),
            F.concat(F.expr(f"left(token, length(token) - {len(ending)})"), F.lit(replacement)),
        )
        for ending, replacement in C.NOUN_RULES
    ]
    keys = F.filter(F.array(F.col("token"), *made), lambda c: c.isNotNull() & (c != ""))
    rows = vocab.select("token", F.posexplode(keys).alias("rule", "lemma"))
    known = rows.groupBy("lemma").agg(
        F.bool_or(F.col("rule") == 0).alias("known"),
        F.collect_set(F.when(F.col("rule") > 0, F.col("token"))).alias("tokens"),
    )
    asked = known.where("known").select("lemma", F.explode("tokens").alias("token"))
    best = F.min(F.struct(F.length("lemma").alias("len"), F.col("lemma"))).alias("best")
    return asked.groupBy("token").agg(best).select("token", F.col("best.lemma").alias("lemma"))


def may_change(token: Column) -> Column:
    """Whether a token ends like one of the rules."""
    return reduce(lambda a, b: a | b, [F.endswith(token, F.lit(ending)) for ending, _ in C.NOUN_RULES])


def shipped(lemmas: DataFrame) -> tuple[pa.Array, pa.Array] | None:
    """The table as two columns for the tasks, or None where it is too large to ship."""
    size = F.sum(F.octet_length("token") + F.octet_length("lemma") + 16)
    if (lemmas.agg(size).first()[0] or 0) > SHIPPED:
        return None
    rows = lemmas.select("token", "lemma").toArrow()
    return rows["token"].combine_chunks().cast(pa.string()), rows["lemma"].combine_chunks().cast(pa.string())


def _replaced(tokens: pa.Array, table: tuple[pa.Array, pa.Array]) -> pa.Array:
    """Lists of tokens with the lemmas of a table in their place; each token of a batch is
    looked up once."""
    offsets = tokens.offsets
    words = tokens.values.dictionary_encode()
    known = pc.index_in(words.dictionary, value_set=table[0])
    changed = pc.coalesce(table[1].take(known), words.dictionary)
    return pa.ListArray.from_arrays(offsets, changed.take(words.indices), mask=tokens.is_null() if tokens.null_count else None)


def lemmatize(df: DataFrame, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    """``df`` with every token replaced by its lemma, order and all other columns kept.

    A table of checked size goes to the tasks and rows stay where they are.  For a larger one
    the rows are written with a number each, and only their different tokens that end like a
    rule leave them: they meet the lemma table, and the changes come back as one small map.
    """
    table = shipped(lemmas)
    if table is not None:
        shared = df.sparkSession.sparkContext.broadcast(table)
        look = F.arrow_udf(in_slices(lambda tokens: _replaced(tokens, shared.value)), "array<string>")
        return df.withColumn(tokens_col, look(F.col(tokens_col)))
    return _joined(df, tokens_col, lemmas)


def _joined(df: DataFrame, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    numbered = checkpointed(df.select(F.struct("*").alias("_row"), F.col(tokens_col).alias("_tokens"), F.monotonically_increasing_id().alias("_number")))
    endings = F.array_distinct(F.filter("_tokens", may_change))
    asked = numbered.select("_number", F.explode(endings).alias("token"))
    pairs = lookup_join(asked, lemmas, "token", "inner").groupBy("_number").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_lemmas")
    )
    changed = F.transform(
        "_tokens",
        lambda w: F.when(may_change(w), F.coalesce(F.try_element_at(F.col("_lemmas"), w), w)).otherwise(w),
    )
    tokens = F.when(F.col("_lemmas").isNull(), F.col("_tokens")).otherwise(changed)
    joined = numbered.join(pairs, "_number", "left")
    return joined.select(*[(tokens if c == tokens_col else F.col("_row")[c]).alias(c) for c in df.columns])


def lemma_text(df: DataFrame, text_col: str, lemmas: DataFrame) -> DataFrame:
    """``df`` with the tokens of a single-spaced text replaced by their lemmas."""
    table = shipped(lemmas)
    if table is None:
        listed = df.withColumn(text_col, F.array_remove(F.split(text_col, " "), ""))
        return _joined(listed, text_col, lemmas).withColumn(text_col, F.array_join(text_col, " "))
    shared = df.sparkSession.sparkContext.broadcast(table)
    look = F.arrow_udf(in_slices(lambda texts: pc.binary_join(_replaced(_split(texts), shared.value), " ")), "string")
    return df.withColumn(text_col, look(F.col(text_col)))


def fit_lemmas(df: DataFrame, tokens_col: str) -> DataFrame:
    """The lemma table of a corpus, written once because every use reads it."""
    return checkpointed(lemma_map(vocabulary(df, tokens_col)))
