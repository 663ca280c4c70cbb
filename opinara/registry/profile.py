"""Table profiling, filters, ordering and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.operators import profile as P
from opinara.operators.quantiles import describe as describe_columns
from opinara.registry.base import (
    SQL_RATED,
    SQL_RATINGS,
    SQL_REVIEWS_TEXT,
    SQL_SENTIMENT,
    SQL_TEXTS,
    query,
    sql_cleaned,
    sql_word_count,
    cleaned,
    corpus_lemmas,
    texts,
    with_,
)
from opinara.sources.reviews import documents, ratings_only, reviews_ratings, reviews_text

RAW = "coalesce(\"reviewText\", '')"


def _round(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _labelled(spark, sf_dir):
    return reviews_ratings(spark, sf_dir).withColumn("sentiment", S.label_sentiment(F.col("overall")))


SQL_LABELLED = f"labelled AS (SELECT *, {SQL_SENTIMENT} AS sentiment FROM reviews_ratings)"


@query(
    "scan_reviews",
    with_(SQL_REVIEWS_TEXT)
    + 'SELECT review_id, overall, "reviewText", "reviewerID", asin, "unixReviewTime" FROM reviews_text',
)
def scan_reviews(spark, sf_dir):
    return reviews_text(spark, sf_dir)


@query(
    "scan_ratings",
    with_(SQL_RATINGS)
    + 'SELECT review_id, overall, "reviewerID", asin, "unixReviewTime" FROM reviews_ratings',
)
def scan_ratings(spark, sf_dir):
    return reviews_ratings(spark, sf_dir).drop("reviewText")


@query(
    "count_mean_rating",
    with_(SQL_RATINGS)
    + "SELECT count(*) AS total_reviews, round(avg(overall), 6) AS average_rating FROM reviews_ratings",
)
def count_mean_rating(spark, sf_dir):
    return _round(P.count_mean(reviews_ratings(spark, sf_dir)), ["average_rating"])


def _sql_describe(source: str, column: str) -> str:
    x = f'CAST("{column}" AS DOUBLE)'
    return (
        f"SELECT '{column}' AS \"column\", count({x}) AS \"count\", round(avg({x}), 6) AS mean, "
        f"round(stddev_samp({x}), 6) AS std, min({x}) AS \"min\", "
        f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
        f"round(quantile_cont({x}, 0.75), 6) AS q75, max({x}) AS \"max\" FROM {source}"
    )


STATS = ["mean", "std", "q25", "q50", "q75"]
_LENGTHS = f"lengths AS (SELECT length({RAW}) AS raw_chars, len(regexp_extract_all({RAW}, '[^{T.BLANKS}]+')) AS word_count FROM texts)"


@query(
    "describe",
    with_(SQL_RATINGS)
    + _sql_describe("reviews_ratings", "overall")
    + " UNION ALL "
    + _sql_describe("reviews_ratings", "unixReviewTime"),
)
def describe(spark, sf_dir):
    df = reviews_ratings(spark, sf_dir)
    return _round(describe_columns(df, P.numeric_columns(df)), STATS)


@query(
    "describe_length",
    with_(SQL_TEXTS, _LENGTHS)
    + _sql_describe("lengths", "raw_chars")
    + " UNION ALL "
    + _sql_describe("lengths", "word_count"),
)
def describe_length(spark, sf_dir):
    text = T.fill_text("reviewText")
    df = texts(spark, sf_dir).select(
        T.char_length(text).alias("raw_chars"), T.word_count(text).alias("word_count")
    )
    return _round(describe_columns(df, ["raw_chars", "word_count"]), STATS)


@query(
    "rating_distribution",
    with_(SQL_RATINGS) + "SELECT overall, count(*) AS n FROM reviews_ratings WHERE overall IS NOT NULL GROUP BY 1",
)
def rating_distribution(spark, sf_dir):
    return P.rating_distribution(reviews_ratings(spark, sf_dir))


@query(
    "sort_by_key",
    with_(SQL_REVIEWS_TEXT)
    + "SELECT overall, count(*) AS n FROM reviews_text WHERE overall IS NOT NULL GROUP BY 1 ORDER BY 1",
)
def sort_by_key(spark, sf_dir):
    return P.rating_distribution(reviews_text(spark, sf_dir))


@query(
    "sentiment_distribution",
    with_(
        SQL_RATINGS,
        SQL_LABELLED,
        "wanted(position, sentiment) AS (VALUES (0, 'Positive'), (1, 'Neutral'), (2, 'Negative'))",
        "counts AS (SELECT sentiment, count(*) AS n FROM labelled GROUP BY 1)",
    )
    + "SELECT position, sentiment, n FROM wanted LEFT JOIN counts USING (sentiment)",
)
def sentiment_distribution(spark, sf_dir):
    return P.sentiment_distribution(_labelled(spark, sf_dir))


@query(
    "rating_share",
    with_(SQL_RATINGS)
    + "SELECT overall, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM reviews_ratings GROUP BY 1",
)
def rating_share(spark, sf_dir):
    return P.rating_share(reviews_ratings(spark, sf_dir))


@query(
    "share_of_total",
    with_(SQL_RATINGS, SQL_LABELLED)
    + "SELECT sentiment, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM labelled GROUP BY 1",
)
def share_of_total(spark, sf_dir):
    from opinara.operators.evaluate import share_of_total as shares

    return _round(shares(P.value_counts(_labelled(spark, sf_dir), "sentiment")), ["share"])


def _sizes(key):
    return f'sizes AS (SELECT "{key}", count(*) AS n_reviews FROM reviews_ratings GROUP BY 1)'


@query(
    "reviews_per_product",
    with_(SQL_RATINGS, _sizes("asin")) + _sql_describe("sizes", "n_reviews"),
)
def reviews_per_product(spark, sf_dir):
    return _round(P.describe_group_sizes(reviews_ratings(spark, sf_dir), "asin"), STATS)


@query(
    "reviews_per_user",
    with_(SQL_RATINGS, _sizes("reviewerID")) + _sql_describe("sizes", "n_reviews"),
)
def reviews_per_user(spark, sf_dir):
    return _round(P.describe_group_sizes(reviews_ratings(spark, sf_dir), "reviewerID"), STATS)


def _sql_histogram(source: str, column: str, bins: int, bounds: str | None = None) -> str:
    limits = (
        "SELECT min(x) AS a, max(x) AS b FROM src" if bounds is None else f"SELECT {bounds}"
    )
    return (
        f'src AS (SELECT CAST("{column}" AS DOUBLE) AS x FROM {source} WHERE "{column}" IS NOT NULL), '
        f"ends AS ({limits}), "
        "lim AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM ends), "
        f"binned AS (SELECT least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS bin, count(*) AS n FROM src, lim WHERE x >= lo AND x <= hi GROUP BY 1), "
        f"bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) "
        f"SELECT bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS left_edge, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS right_edge, coalesce(n, 0) AS n FROM bins LEFT JOIN binned USING (bin), lim"
    )


@query(
    "histogram",
    "WITH " + SQL_TEXTS + ", " + _LENGTHS + ", " + _sql_histogram("lengths", "raw_chars", 50),
)
def histogram(spark, sf_dir):
    df = texts(spark, sf_dir).select(T.char_length(T.fill_text("reviewText")).alias("raw_chars"))
    return _round(P.histogram(df, "raw_chars", 50), ["left_edge", "right_edge"])


@query(
    "histogram_fixed_range",
    "WITH "
    + SQL_RATINGS
    + ", "
    + _sql_histogram("reviews_ratings", "overall", 5, "0.5::DOUBLE AS a, 5.5::DOUBLE AS b"),
)
def histogram_fixed_range(spark, sf_dir):
    return P.histogram(reviews_ratings(spark, sf_dir), "overall", 5, (0.5, 5.5))


@query(
    "histogram_product_sizes",
    "WITH " + SQL_RATINGS + ", " + _sizes("asin") + ", " + _sql_histogram("sizes", "n_reviews", 30),
)
def histogram_product_sizes(spark, sf_dir):
    sizes = P.group_sizes(reviews_ratings(spark, sf_dir), "asin")
    return _round(P.histogram(sizes, "n_reviews", 30), ["left_edge", "right_edge"])


@query(
    "box_by_rating",
    with_(
        SQL_REVIEWS_TEXT,
        "v AS (SELECT overall, CAST(length(\"reviewText\") AS DOUBLE) AS x FROM reviews_text WHERE overall IS NOT NULL)",
        "q AS (SELECT overall, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM v GROUP BY 1)",
        "f AS (SELECT v.overall, x, q25, q50, q75, (x >= q25 - 1.5 * (q75 - q25) AND x <= q75 + 1.5 * (q75 - q25)) AS inside FROM v JOIN q USING (overall))",
    )
    + "SELECT overall, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, count(*) AS n, "
    "min(x) FILTER (WHERE inside) AS whisker_low, max(x) FILTER (WHERE inside) AS whisker_high, "
    "count(*) FILTER (WHERE NOT inside) AS n_outliers FROM f GROUP BY overall, q25, q50, q75",
)
def box_by_rating(spark, sf_dir):
    df = reviews_text(spark, sf_dir).select("overall", F.length("reviewText").alias("raw_chars"))
    return _round(P.box_statistics(df, "overall", "raw_chars"), ["q25", "q50", "q75"])


_COLUMNS = ["review_id", "reviewText", "asin", "reviewerID", "unixReviewTime", "overall"]


@query(
    "null_counts",
    with_(SQL_REVIEWS_TEXT)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE \"{c}\" IS NULL) AS missing FROM reviews_text"
        for c in _COLUMNS
    ),
)
def null_counts(spark, sf_dir):
    return P.null_counts(reviews_text(spark, sf_dir))


_TYPES = ["bigint", "string", "string", "string", "bigint", "double"]


@query(
    "table_info",
    with_(SQL_REVIEWS_TEXT)
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count(\"{c}\") AS non_null, count(*) AS rows FROM reviews_text"
        for i, (c, t) in enumerate(zip(_COLUMNS, _TYPES))
    ),
)
def table_info(spark, sf_dir):
    return P.table_info(reviews_text(spark, sf_dir))


def _sql_duplicates(source: str, columns: str) -> str:
    return (
        f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_involved "
        f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"
    )


@query("duplicate_rows", with_(SQL_RATINGS) + _sql_duplicates("reviews_ratings", 'overall, "unixReviewTime"'))
def duplicate_rows(spark, sf_dir):
    return P.duplicate_numeric_rows(reviews_ratings(spark, sf_dir))


@query(
    "duplicate_keys",
    with_(SQL_RATINGS)
    + _sql_duplicates("reviews_ratings", '"reviewerID", asin, "reviewText", "unixReviewTime"'),
)
def duplicate_keys(spark, sf_dir):
    return P.duplicate_counts(
        reviews_ratings(spark, sf_dir), ["reviewerID", "asin", "reviewText", "unixReviewTime"]
    )


@query("duplicate_texts", with_(SQL_TEXTS) + _sql_duplicates("texts", '"reviewText"'))
def duplicate_texts(spark, sf_dir):
    return P.duplicate_counts(texts(spark, sf_dir), ["reviewText"])


@query(
    "value_counts",
    with_(SQL_RATINGS, SQL_LABELLED)
    + "SELECT sentiment, count(*) AS n FROM labelled GROUP BY 1 ORDER BY n DESC, sentiment",
)
def value_counts(spark, sf_dir):
    return P.value_counts(_labelled(spark, sf_dir), "sentiment")


@query(
    "class_balance_check",
    with_(SQL_RATINGS, SQL_LABELLED)
    + "SELECT min(n) AS smallest_class FROM (SELECT sentiment, count(*) AS n FROM labelled GROUP BY 1)",
)
def class_balance_check(spark, sf_dir):
    return P.smallest_class(_labelled(spark, sf_dir))


@query(
    "count_long",
    with_(SQL_TEXTS) + f"SELECT count(*) FILTER (WHERE {sql_word_count(RAW)} > 100) AS n FROM texts",
)
def count_long(spark, sf_dir):
    long = T.word_count(T.fill_text("reviewText")) > C.LONG_REVIEW_WORDS
    return P.count_long(texts(spark, sf_dir), long)


@query(
    "long_reviews",
    with_(SQL_TEXTS)
    + f"SELECT review_id, {sql_word_count(RAW)} AS word_count FROM texts WHERE {sql_word_count(RAW)} > 100",
)
def long_reviews(spark, sf_dir):
    from opinara.operators.generate import long_reviews as select_long

    return select_long(texts(spark, sf_dir)).select("review_id", "word_count")


_QUESTIONS = f"questions AS (SELECT review_id, {sql_word_count(RAW)} AS word_count FROM texts WHERE contains({RAW}, '?') AND {sql_word_count(RAW)} >= 20)"


@query("question_reviews", with_(SQL_TEXTS, _QUESTIONS) + "SELECT review_id, word_count FROM questions")
def question_reviews(spark, sf_dir):
    from opinara.operators.generate import question_reviews as select_questions

    return select_questions(texts(spark, sf_dir)).select("review_id", "word_count")


@query(
    "first_match",
    with_(SQL_TEXTS, _QUESTIONS) + "SELECT review_id, word_count FROM questions ORDER BY review_id LIMIT 1",
)
def first_match(spark, sf_dir):
    from opinara.operators.generate import first_row
    from opinara.operators.generate import question_reviews as select_questions

    return first_row(select_questions(texts(spark, sf_dir)).select("review_id", "word_count"))


@query(
    "class_filter",
    with_(SQL_RATINGS, SQL_LABELLED) + "SELECT review_id, overall FROM labelled WHERE sentiment = 'Negative'",
)
def class_filter(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.col("sentiment") == "Negative").select("review_id", "overall")


@query(
    "select_numeric_cols",
    with_(SQL_RATINGS) + 'SELECT overall, "unixReviewTime" FROM reviews_ratings',
)
def select_numeric_cols(spark, sf_dir):
    return P.select_numeric(reviews_ratings(spark, sf_dir))


@query(
    "project_preview",
    with_(SQL_TEXTS, sql_cleaned("texts", '"reviewText"'))
    + 'SELECT review_id, "reviewText", cleaned_text FROM cleaned ORDER BY review_id LIMIT 5',
)
def project_preview(spark, sf_dir):
    """Cleans only the five rows that survive the limit, with the corpus's lemma table."""
    rows = texts(spark, sf_dir)
    shown = rows.orderBy("review_id").limit(5).withColumn("shown", F.col("reviewText"))
    return cleaned(shown, corpus_lemmas(rows)).select("review_id", F.col("shown").alias("reviewText"), "cleaned_text")


@query(
    "head",
    with_(SQL_RATED) + 'SELECT review_id, overall, asin FROM rated ORDER BY review_id LIMIT 10',
)
def head(spark, sf_dir):
    narrow = documents(spark, sf_dir).select("review_id", "asin")
    joined = narrow.join(ratings_only(spark, sf_dir), "review_id")
    return joined.select("review_id", "overall", "asin").orderBy("review_id").limit(10)
