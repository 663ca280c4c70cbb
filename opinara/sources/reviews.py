"""Review tables: schema, JSON-lines reader and adapters for the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.session import checkpointed

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("overall", T.DoubleType()),
        T.StructField("reviewText", T.StringType()),
        T.StructField("reviewerID", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("unixReviewTime", T.LongType()),
    ]
)


def scan_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    """Line-delimited JSON with a declared schema: no inference pass, splittable."""
    return spark.read.schema(schema).json(path)


def with_review_id(df: DataFrame, name: str = "review_id") -> DataFrame:
    """A unique key for sources without one.

    The position part follows the file splits, which depend on the cluster.  So the keyed
    table is written to the shared folder here, and all later steps read the same keys.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    content = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return checkpointed(df.withColumn(name, F.concat_ws("-", content, F.monotonically_increasing_id())))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in review columns, without a rating; one scan, no join."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("reviewText"),
        F.col("source").alias("asin"),
        F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("reviewerID"),
        (F.col("doc_id") * 86400).alias("unixReviewTime"),
    )


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 5.0)
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), 3.0)
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), 2.0)
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), 1.0)
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), stars.alias("overall"))


def reviews_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; unlabelled ones have a null rating."""
    return documents(spark, sf_dir).join(_ratings(spark, sf_dir), "review_id", "left")


def rated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a rating: the input of sampling, training and evaluation."""
    return documents(spark, sf_dir).join(_ratings(spark, sf_dir), "review_id")


def ratings_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, overall) of rated documents, from the narrow table alone."""
    return _ratings(spark, sf_dir)


def reviews_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating volume: orders joined with lineitem; the key hashes five columns."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.md5(
            F.concat_ws(
                ":",
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            )
        ).alias("review_id"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("overall"),
        F.lit(None).cast("string").alias("reviewText"),
        F.col("o_custkey").cast("string").alias("reviewerID"),
        F.col("l_partkey").cast("string").alias("asin"),
        (F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400).alias(
            "unixReviewTime"
        ),
    )
