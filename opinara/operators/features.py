"""TF-IDF and scaled numeric features.

Vocabularies that can be shipped are applied row by row (`operators.terms`); for larger ones the
long forms here join them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opinara.config import TfidfConfig
from opinara.functions import text as T
from opinara.operators import terms as V
from opinara.session import checkpointed

NUMERIC_FEATURES = ("review_length", "exclamation_count", "uppercase_count")


def with_numeric_features(df: DataFrame, marked: str = "review_neg", cleaned: str = "cleaned_text") -> DataFrame:
    """The three counts; ``marked`` is the single-spaced output of negation marking."""
    return df.withColumns(
        {
            "review_length": T.char_length(F.col(cleaned)),
            "exclamation_count": T.exclamation_count(F.col(marked)),
            "uppercase_count": T.uppercase_count(F.col(marked), collapsed=True),
        }
    )


def document_terms(df: DataFrame, cleaned: str = "cleaned_text", id_col: str = "review_id", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, term, tf): counted inside each row, so this step does not shuffle."""
    counted = T.term_counts(T.terms(F.col(cleaned)))
    return df.select(id_col, *keep, F.inline(counted))


def vocab_stats(docs: DataFrame, cleaned: str = "cleaned_text") -> DataFrame:
    """(term, tf, df): corpus frequency and document frequency."""
    return V.count_terms(docs, cleaned)


def fit_vocabulary(stats: DataFrame, docs: DataFrame, config: TfidfConfig = TfidfConfig()) -> DataFrame:
    """(term, tf, df, n_docs, idf): frequency limits, then the largest corpus frequencies.

    At most ``max_features`` rows, written once because fitting and applying read them.
    """
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return checkpointed(
        stats.withColumn("n_docs", n_docs)
        .where((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * F.col("n_docs")))
        .orderBy(F.desc("tf"), F.asc("term"))
        .limit(config.max_features)
        .withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1.0)
    )


def tfidf_weights(
    docs: DataFrame, vocabulary: DataFrame, id_col: str = "review_id", keep: Sequence[str] = (), cleaned: str = "cleaned_text"
) -> DataFrame:
    """(id, keep, term, weight), unit length per document; unknown terms are dropped."""
    known = V.shipped(vocabulary)
    if known is None:
        return joined_weights(document_terms(docs, cleaned, id_col, keep), vocabulary, id_col, keep)
    return V.weight_rows(docs, known, id_col, keep, cleaned)


def joined_weights(
    doc_terms: DataFrame, vocabulary: DataFrame, id_col: str = "review_id", keep: Sequence[str] = ()
) -> DataFrame:
    """`tfidf_weights` of long-form terms for a vocabulary of any size, by joins.

    The parts of a document are summed by its id, which must be unique and not null.
    """
    raw = doc_terms.join(vocabulary.select("term", "idf"), "term").withColumn("raw", (1.0 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(id_col)))
    return raw.withColumn("weight", F.col("raw") / norm).select(id_col, *keep, "term", "weight")


def known_terms(docs: DataFrame, vocabulary: DataFrame, id_col: str = "review_id", cleaned: str = "cleaned_text") -> DataFrame:
    """(id, n_known, idf_mass): how many terms of the vocabulary a document has, and its sum of
    counts times idf; documents without any are left out."""
    known = V.shipped(vocabulary)
    if known is None:
        joined = document_terms(docs, cleaned, id_col).join(vocabulary.select("term", "idf"), "term")
        return joined.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_known"), F.sum(F.col("tf") * F.col("idf")).alias("idf_mass"))
    rows = docs.select(id_col, V.known_mass(docs, known, cleaned).alias("k"))
    return rows.select(id_col, "k.*").where("n_known > 0")


def mean_weights(docs: DataFrame, vocabulary: DataFrame, cleaned: str = "cleaned_text", id_col: str = "review_id") -> DataFrame:
    """Mean weight of a term over all documents; absence counts as 0."""
    known = V.shipped(vocabulary)
    if known is None:
        weights = joined_weights(document_terms(docs, cleaned, id_col), vocabulary, id_col)
        totals = weights.groupBy("term").agg(F.sum("weight").alias("total"))
    else:
        totals = V.total_weights(docs, known, cleaned)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.select("term", (F.col("total") / n_docs).alias("mean_weight"))


def top_terms(means: DataFrame, k: int = 20) -> DataFrame:
    return means.orderBy(F.desc(F.round("mean_weight", 9)), F.asc("term")).limit(k)


def matrix_shape(docs: DataFrame, vocabulary: DataFrame, id_col: str = "review_id", cleaned: str = "cleaned_text") -> DataFrame:
    """Documents, features and stored entries."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_terms = vocabulary.agg(F.count(F.lit(1)).alias("n")).scalar()
    stored = known_terms(docs, vocabulary, id_col, cleaned).agg(F.coalesce(F.sum("n_known"), F.lit(0)).alias("nnz"))
    return stored.select(n_docs.alias("n_docs"), n_terms.alias("n_terms"), "nnz")


def minmax_fit(df: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """(feature, lo, hi): one scan."""
    sums = df.agg(
        *[F.min(c).cast("double").alias(f"{c}_lo") for c in columns],
        *[F.max(c).cast("double").alias(f"{c}_hi") for c in columns],
    )
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi"))
        for c in columns
    ]
    return sums.select(F.inline(F.array(*rows)))


def scale(value: Column, low: Column, high: Column) -> Column:
    """(x - lo) / (hi - lo), not clipped; a constant column becomes 0."""
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - low) / width


def minmax_scale(df: DataFrame, train: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """Replace each column by its scaled value, using the extremes of ``train``."""
    limits = train.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}_lo") for c in columns],
            *[F.max(c).cast("double").alias(f"{c}_hi") for c in columns],
        ).alias("limits")
    ).scalar()
    return df.withColumns(
        {c: scale(F.col(c), limits.getField(f"{c}_lo"), limits.getField(f"{c}_hi")) for c in columns}
    )


def sparse_features(
    rows: DataFrame,
    train: DataFrame,
    vocabulary: DataFrame,
    id_col: str = "review_id",
    keep: Sequence[str] = (),
    cleaned: str = "cleaned_text",
    columns: Sequence[str] = NUMERIC_FEATURES,
) -> tuple[DataFrame, int]:
    """(id, keep, features struct<terms, weights>) and the number of features.

    The numbers of the vocabulary's terms are followed by those of the numeric columns, scaled
    by the extremes of ``train``.
    """
    known = V.shipped(vocabulary)
    scaled = minmax_scale(rows, train, columns)
    if known is None:
        n_terms = vocabulary.count()
        numbers = checkpointed(vocabulary.select("term", "idf", (F.row_number().over(W.orderBy("term")) - 1).alias("number")))
        weights = joined_weights(document_terms(rows, cleaned, id_col), numbers, id_col).join(numbers.select("term", "number"), "term")
        lists = weights.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("_v"))  # a text's own terms
        scaled = scaled.join(lists, id_col, "left").withColumn("_v", F.coalesce("_v", F.expr("array()")))
        vector = F.struct(F.col("_v.number").alias("terms"), F.col("_v.weight").alias("weights"))
    else:
        n_terms = len(known)
        vector = V.term_vectors(rows, known, cleaned)
    scaled = scaled.select(id_col, *keep, *columns, vector.alias("_vector"))
    terms = F.concat("_vector.terms", F.array(*[F.lit(n_terms + i) for i in range(len(columns))]))
    weights = F.concat("_vector.weights", F.array(*[F.col(c).cast("double") for c in columns]))
    return scaled.select(id_col, *keep, F.struct(terms.alias("terms"), weights.alias("weights")).alias("features")), n_terms + len(columns)
