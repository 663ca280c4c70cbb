"""Sampling, splitting, folds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import scores as S
from opinara.operators import profile as P
from opinara.operators import sampling as M
from opinara.registry.base import (
    SQL_RATED,
    SQL_RATINGS,
    SQL_SENTIMENT,
    query,
    sql_key,
    with_,
)
from opinara.sources.reviews import documents, rated_reviews, ratings_only, reviews_ratings

KEY = sql_key()
ORDER = f"{KEY}, CAST(review_id AS VARCHAR)"


def rated_labels(spark, sf_dir):
    return ratings_only(spark, sf_dir).withColumn("sentiment", S.label_sentiment(F.col("overall")))


SQL_BASE = f"base AS (SELECT review_id, overall, {SQL_SENTIMENT} AS sentiment FROM rated)"
SQL_BASE_VOLUME = (
    f"base AS (SELECT review_id, overall, {SQL_SENTIMENT} AS sentiment FROM reviews_ratings)"
)


def sql_allocation(size: str, stratum: str = "overall", source: str = "base") -> str:
    return (
        f"strata AS (SELECT {stratum} AS stratum, count(*) AS n FROM {source} GROUP BY 1), "
        f"sized AS (SELECT *, {size} AS size FROM (SELECT *, sum(n) OVER () AS total FROM strata)), "
        "shares AS (SELECT *, size * n / total::DOUBLE AS share FROM sized), "
        "bases AS (SELECT *, floor(share) AS base_n, round(share - floor(share), 9) AS fraction FROM shares), "
        "placed AS (SELECT *, size - sum(base_n) OVER () AS missing, row_number() OVER (ORDER BY fraction DESC, stratum) AS place FROM bases), "
        "alloc AS (SELECT stratum, n, CAST(base_n + CASE WHEN place <= missing THEN 1 ELSE 0 END AS BIGINT) AS quota FROM placed)"
    )


SQL_TRAIN_SIZE = "total - ceil(round(total * 0.3::DOUBLE, 9))"
SQL_SPLIT = (
    sql_allocation(SQL_TRAIN_SIZE)
    + f", ranked AS (SELECT *, row_number() OVER (PARTITION BY overall ORDER BY {ORDER}) AS rn FROM base), "
    "split AS (SELECT r.review_id, r.overall, r.sentiment, CASE WHEN rn <= quota THEN 'train' ELSE 'test' END AS split FROM ranked r JOIN alloc ON r.overall IS NOT DISTINCT FROM stratum)"
)


def split_rows(spark, sf_dir):
    return M.split_stratified(rated_labels(spark, sf_dir))


def split_volume(spark, sf_dir):
    df = reviews_ratings(spark, sf_dir).select("review_id", "overall")
    return M.split_stratified(df.withColumn("sentiment", S.label_sentiment(F.col("overall"))))


@query(
    "sample_simple",
    with_(SQL_RATINGS) + f"SELECT review_id, overall FROM reviews_ratings ORDER BY {ORDER} LIMIT 1000",
)
def sample_simple(spark, sf_dir):
    return M.sample_simple(reviews_ratings(spark, sf_dir).select("review_id", "overall"), 1000)


@query(
    "sample_balanced",
    with_(
        SQL_RATINGS,
        SQL_BASE_VOLUME,
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY {ORDER}) AS rn FROM base)",
        "smallest AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM base GROUP BY sentiment))",
    )
    + "SELECT review_id, sentiment FROM ranked, smallest WHERE rn <= m",
)
def sample_balanced(spark, sf_dir):
    df = reviews_ratings(spark, sf_dir).select("review_id", "overall")
    labelled = df.select("review_id", S.label_sentiment(F.col("overall")).alias("sentiment"))
    return M.sample_balanced(labelled)


@query(
    "rank_in_class",
    with_(
        SQL_RATED,
        SQL_BASE,
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY {ORDER}) AS rn FROM base)",
    )
    + "SELECT review_id, sentiment, rn FROM ranked",
)
def rank_in_class(spark, sf_dir):
    return M.rank_in_group(rated_labels(spark, sf_dir), ["sentiment"]).select(
        "review_id", "sentiment", "rn"
    )


@query(
    "sample_stratified",
    with_(
        SQL_RATINGS,
        SQL_BASE_VOLUME,
        sql_allocation("2000"),
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY overall ORDER BY {ORDER}) AS rn FROM base)",
    )
    + "SELECT review_id, overall FROM ranked JOIN alloc ON overall = stratum WHERE rn <= quota",
)
def sample_stratified(spark, sf_dir):
    df = reviews_ratings(spark, sf_dir).select("review_id", "overall")
    return M.sample_stratified(df, 2000)


@query(
    "strata_allocation",
    with_(SQL_RATINGS, SQL_BASE_VOLUME, sql_allocation(SQL_TRAIN_SIZE))
    + "SELECT stratum, n, quota FROM alloc",
)
def strata_allocation(spark, sf_dir):
    counts = M.strata_counts(reviews_ratings(spark, sf_dir), "overall")
    return M.train_quotas(counts, 0.30)


@query(
    "split_stratified",
    with_(SQL_RATINGS, SQL_BASE_VOLUME, SQL_SPLIT) + "SELECT review_id, overall, split FROM split",
)
def split_stratified(spark, sf_dir):
    return split_volume(spark, sf_dir).select("review_id", "overall", "split")


@query(
    "test_rows_semi",
    with_(SQL_RATED, SQL_BASE, SQL_SPLIT)
    + 'SELECT review_id, "reviewText" FROM rated WHERE review_id IN (SELECT review_id FROM split WHERE split = \'test\')',
)
def test_rows_semi(spark, sf_dir):
    test_ids = split_rows(spark, sf_dir).where("split = 'test'").select("review_id")
    return documents(spark, sf_dir).join(test_ids, "review_id", "left_semi").select(
        "review_id", "reviewText"
    )


@query(
    "train_rows_anti",
    with_(SQL_RATED, SQL_BASE, SQL_SPLIT)
    + 'SELECT review_id, "reviewText" FROM rated WHERE review_id NOT IN (SELECT review_id FROM split WHERE split = \'test\')',
)
def train_rows_anti(spark, sf_dir):
    test_ids = split_rows(spark, sf_dir).where("split = 'test'").select("review_id")
    return rated_reviews(spark, sf_dir).join(test_ids, "review_id", "left_anti").select(
        "review_id", "reviewText"
    )


@query(
    "fold_assignment",
    with_(
        SQL_RATED,
        SQL_BASE,
        SQL_SPLIT,
        f"f AS (SELECT review_id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY {ORDER}) AS rn FROM split WHERE split = 'train')",
    )
    + "SELECT review_id, sentiment, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM f",
)
def fold_assignment(spark, sf_dir):
    train = split_rows(spark, sf_dir).where("split = 'train'").select("review_id", "sentiment")
    return M.assign_folds(train)


@query(
    "renumber",
    with_(SQL_RATED)
    + f"SELECT review_id, CAST(row_number() OVER (ORDER BY {ORDER}) - 1 AS INTEGER) AS index FROM (SELECT review_id FROM rated ORDER BY {ORDER} LIMIT 10)",
)
def renumber(spark, sf_dir):
    sample = M.sample_simple(ratings_only(spark, sf_dir).select("review_id"), 10)
    return M.renumber(sample, [M.order_key("review_id", 42)])


@query(
    "shuffle",
    with_(SQL_RATED, SQL_BASE)
    + f"SELECT review_id, sentiment, {KEY} AS shuffle_key FROM base ORDER BY shuffle_key, CAST(review_id AS VARCHAR)",
)
def shuffle(spark, sf_dir):
    """A permutation is a sort by the hashed key; a range-partitioned sort at any size."""
    key = F.md5(F.concat_ws("|", F.col("review_id").cast("string"), F.lit("42")))
    return (
        rated_labels(spark, sf_dir)
        .select("review_id", "sentiment", key.alias("shuffle_key"))
        .orderBy("shuffle_key", F.col("review_id").cast("string"))
    )


@query(
    "union_classes",
    with_(SQL_RATED, SQL_BASE)
    + "SELECT review_id, sentiment FROM base WHERE sentiment = 'Positive' UNION ALL "
    "SELECT review_id, sentiment FROM base WHERE sentiment = 'Neutral' UNION ALL "
    "SELECT review_id, sentiment FROM base WHERE sentiment = 'Negative'",
)
def union_classes(spark, sf_dir):
    df = rated_labels(spark, sf_dir).select("review_id", "sentiment")
    parts = [df.where(F.col("sentiment") == c) for c in ("Positive", "Neutral", "Negative")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "split_summary",
    with_(SQL_RATINGS, SQL_BASE_VOLUME, SQL_SPLIT)
    + "SELECT split, 'rows' AS kind, '' AS key, count(*) AS n FROM split GROUP BY split UNION ALL "
    "SELECT split, 'class', sentiment, count(*) FROM split GROUP BY split, sentiment UNION ALL "
    "SELECT split, 'rating', CAST(CAST(overall AS INTEGER) AS VARCHAR), count(*) FROM split GROUP BY split, overall",
)
def split_summary(spark, sf_dir):
    return P.split_summary(split_volume(spark, sf_dir))


@query(
    "split_percent",
    with_(SQL_RATINGS, SQL_BASE_VOLUME, SQL_SPLIT)
    + "SELECT split, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM split GROUP BY split",
)
def split_percent(spark, sf_dir):
    return P.split_percent(split_volume(spark, sf_dir))
