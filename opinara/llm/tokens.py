"""Token counts through an exact histogram of encoded lengths.

Each text is encoded once where it is read; only (length, documents) is shuffled, already
summed per task.  The histogram is written, since block totals and sums inside blocks both read
it.  Suffix sums over the lengths then answer totals, quantiles and truncated
totals for every context limit.

Defined results: null and empty texts have length 0; an empty table gives an empty histogram;
repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.common import scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Splitting rule that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of each whole text; the vocabulary is read once per worker."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def histogram(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs), exact."""
    return docs.select(encoded_length(F.col(text_col), path).alias("n_tokens")).groupBy("n_tokens").agg(
        F.count("*").alias("n_docs")
    )


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: documents and tokens at that length or beyond, and the truncated total.

    `truncated_total` is what remains of the corpus when every text is cut to `n_tokens`.
    Sums run inside blocks of lengths; the few block totals are summed apart and joined back,
    so no task holds all lengths.
    """
    h = scratch(hist).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "_tokens", F.col("n_tokens") * F.col("n_docs")
    )
    inside = W.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = h.groupBy("_block").agg(F.sum("n_docs").alias("d"), F.sum("_tokens").alias("t"))
    # One row per BLOCK lengths: the longest text divided by BLOCK bounds this window.
    after = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    later = totals.select(
        "_block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("_t"),
        F.sum("d").over(W.partitionBy()).alias("_docs"),
        F.sum("t").over(W.partitionBy()).alias("_all"),
    )
    return (
        h.withColumn("_di", F.sum("n_docs").over(inside))
        .withColumn("_ti", F.sum("_tokens").over(inside))
        .join(later, "_block")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("_di") + F.col("_d")).alias("docs_from"),
            (F.col("_ti") + F.col("_t")).alias("tokens_from"),
            (F.col("_all") - F.col("_ti") - F.col("_t") + F.col("n_tokens") * (F.col("_di") + F.col("_d"))).alias(
                "truncated_total"
            ),
            F.col("_docs").alias("total_docs"),
            F.col("_all").alias("total_tokens"),
        )
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when texts are cut to `limit`: read off the first length at or above it."""
    above = sums.where(F.col("n_tokens") >= limit).agg(F.min(F.struct("n_tokens", "docs_from", "tokens_from", "total_tokens")).alias("x")).first()
    if above["x"] is None:
        total = sums.agg(F.max("total_tokens")).first()[0]
        return total or 0
    x = above["x"]
    return x["total_tokens"] - x["tokens_from"] + limit * x["docs_from"]


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length with at least a share q of the documents at or below it."""
    at = sums.where((F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) >= F.col("total_docs") * F.lit(q))
    return at.agg(F.min("n_tokens")).first()[0]
