"""Review-table profiling: distributions, nulls, duplicates, histograms, box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opinara.functions import constants as C
from opinara.operators.quantiles import describe, exact_quantiles, value_counts_by
from opinara.session import checkpointed

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t.startswith(NUMERIC)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def count_mean(df: DataFrame, rating: str = "overall") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_reviews"), F.avg(rating).alias("average_rating"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, nulls left out, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
    )


def rating_distribution(df: DataFrame, rating: str = "overall") -> DataFrame:
    return (
        df.where(F.col(rating).isNotNull())
        .groupBy(rating)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(rating)
    )


def sentiment_distribution(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Counts in display order; a class without rows has a null count."""
    order = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in C.DISPLAY_ORDER])).alias("position", label)
    )
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return order.join(counts, label, "left").select("position", label, "n").orderBy("position")


def rating_share(df: DataFrame, rating: str = "overall") -> DataFrame:
    """Percentage per rating, from the already aggregated counts."""
    counts = rating_distribution(df, rating)
    whole = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.select(rating, "n", F.round(100.0 * F.col("n") / whole, 1).alias("percent"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"))


def describe_group_sizes(df: DataFrame, key: str) -> DataFrame:
    return describe(group_sizes(df, key), ["n_reviews"])


def histogram(
    df: DataFrame, column: str, bins: int, value_range: tuple[float, float] | None = None
) -> DataFrame:
    """Equal-width bins over [min, max] (or a given range), last bin closed, empties kept."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    if value_range is None:
        bounds = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("b")).scalar()
        flat = bounds.getField("lo") == bounds.getField("hi")
        lo = F.when(flat, bounds.getField("lo") - 0.5).otherwise(bounds.getField("lo"))
        hi = F.when(flat, bounds.getField("hi") + 0.5).otherwise(bounds.getField("hi"))
    else:
        lo, hi = F.lit(float(value_range[0])), F.lit(float(value_range[1]))
    width = (hi - lo) / bins
    counts = (
        rows.where((F.col("x") >= lo) & (F.col("x") <= hi))
        .select(
            F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        all_bins.join(counts, "bin", "left")
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("left_edge"),
            (lo + (F.col("bin") + 1) * width).alias("right_edge"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        )
        .orderBy("bin")
    )


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles per group and the extreme values within 1.5 IQR of the box."""
    known = df.where(F.col(group).isNotNull())
    counts = checkpointed(value_counts_by(known, [group], value))
    quartiles = (
        exact_quantiles(counts, [group], (0.25, 0.5, 0.75))
        .groupBy(group)
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("q"))).alias("q25"),
            F.max(F.when(F.col("prob") == 0.5, F.col("q"))).alias("q50"),
            F.max(F.when(F.col("prob") == 0.75, F.col("q"))).alias("q75"),
        )
    )
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach)
    return (
        counts.join(quartiles, group)
        .groupBy(group, "q25", "q50", "q75")
        .agg(
            F.sum("n").alias("n"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
        .orderBy(group)
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One scan for all columns, then one row per column."""
    sums = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _one_row_to_rows(sums, df.columns, "missing")


def _one_row_to_rows(row: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in columns]
    return row.select(F.inline(F.array(*pairs)))


def table_info(df: DataFrame) -> DataFrame:
    """Column position, name, type, non-null count and row total."""
    sums = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(t).alias("type"),
            F.col(c).alias("non_null"),
            F.col("_rows").alias("rows"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return sums.select(F.inline(F.array(*entries)))


def _key(df: DataFrame, column: str) -> Column:
    """Strings are compared by digest, so long texts are never shuffled."""
    if dict(df.dtypes)[column] == "string":
        return F.sha2(F.col(column), 256).alias(column)
    return F.col(column)


def duplicate_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, and all rows whose key repeats; nulls are equal."""
    copies = F.col("_copies")
    sizes = (
        df.select(*[_key(df, c) for c in columns])
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    return sizes.agg(
        F.coalesce(F.sum(copies - 1), F.lit(0)).cast("bigint").alias("duplicates"),
        F.coalesce(F.sum(F.when(copies > 1, copies)), F.lit(0)).cast("bigint").alias("rows_involved"),
    )


def duplicate_numeric_rows(df: DataFrame) -> DataFrame:
    return duplicate_counts(df, numeric_columns(df))


def split_summary(df: DataFrame) -> DataFrame:
    """Row, class and rating counts of each split in one pass over the data."""
    return (
        df.groupingSets(
            [["split"], ["split", "sentiment"], ["split", "overall"]], "split", "sentiment", "overall"
        )
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
        .select(
            "split",
            F.when(F.col("gid") == 3, "rows").when(F.col("gid") == 1, "class").otherwise("rating").alias("kind"),
            F.coalesce(
                F.when(F.col("gid") == 1, F.col("sentiment")),
                F.when(F.col("gid") == 2, F.col("overall").cast("int").cast("string")),
                F.lit(""),
            ).alias("key"),
            "n",
        )
    )


def split_percent(df: DataFrame) -> DataFrame:
    whole = F.sum("n").over(W.partitionBy(F.lit(1)))
    return (
        df.groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("split", "n", F.round(100.0 * F.col("n") / whole, 1).alias("percent"))
    )


def counts_json(df: DataFrame, column: str) -> DataFrame:
    """Counts by value as one JSON object with sorted keys."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(
        F.collect_list(F.struct(F.col(column).cast("string").alias("k"), F.col("n").alias("v")))
    )
    return counts.agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


def smallest_class(df: DataFrame, label: str = "sentiment") -> DataFrame:
    return (
        df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest_class"))
    )


def count_long(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("n"))


def rating_pair_bins(df: DataFrame, bins: int = 30) -> DataFrame:
    """(original, enhanced) pairs counted on a grid, so plots need no row-level transfer."""
    step = 4.0 / bins
    spot = F.least(F.floor((F.col("enhanced_rating") - 1.0) / step), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col("enhanced_rating").isNotNull())
        .groupBy("overall", spot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
