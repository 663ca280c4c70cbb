"""Exact, reproducible sampling and splitting.

Row order is defined by ``md5(id|seed)``.  To take the first n rows of a stratum no
stratum is ever sorted as a whole: counts per leading hash digits locate the one digit
group that holds the n-th row, only that group is ordered, and the resulting cut-off key
is compared with every row in a map-only pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opinara.session import checkpointed

HASH_DIGITS = 4  # 65,536 groups per stratum


def order_key(id_col: str, seed: int) -> Column:
    """Sort key of a row: hash first, then the id itself so that ties cannot occur."""
    as_text = F.col(id_col).cast("string")
    return F.concat_ws("|", F.md5(F.concat_ws("|", as_text, F.lit(str(seed)))), as_text)


def strata_counts(df: DataFrame, strata: str) -> DataFrame:
    return df.groupBy(F.col(strata).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def largest_remainder(counts: DataFrame, size: Column) -> DataFrame:
    """Add ``quota``: ``size`` rows shared out over (stratum, n) by largest remainder.

    The table has one row per stratum, so its unpartitioned windows stay tiny.
    """
    everything = W.partitionBy(F.lit(1))
    by_fraction = everything.orderBy(F.desc("fraction"), F.asc("stratum"))
    return (
        counts.withColumn("total", F.sum("n").over(everything))
        .withColumn("share", size * F.col("n") / F.col("total"))
        .withColumn("base", F.floor("share"))
        .withColumn("fraction", F.round(F.col("share") - F.col("base"), 9))
        .withColumn("missing", size - F.sum("base").over(everything))
        .withColumn("place", F.row_number().over(by_fraction))
        .withColumn(
            "quota",
            (F.col("base") + F.when(F.col("place") <= F.col("missing"), 1).otherwise(0)).cast("long"),
        )
        .select("stratum", "n", "quota")
    )


def _keyed(df: DataFrame, strata: str, id_col: str, seed: int) -> DataFrame:
    return df.select(
        F.col(strata).alias("stratum"), order_key(id_col, seed).alias("key")
    ).withColumn("digits", F.substring("key", 1, HASH_DIGITS))


def mark_taken(
    df: DataFrame,
    strata: str,
    quotas: Callable[[DataFrame], DataFrame],
    id_col: str,
    seed: int,
    flag: str = "taken",
) -> DataFrame:
    """Add a boolean: row is among the first ``quota`` rows of its stratum.

    ``quotas`` turns (stratum, n) into (stratum, n, quota).  Three passes over the narrow
    key columns: counts per hash group (written once; everything about quotas derives from
    that small table), the one group per stratum that holds the cut-off, and the final
    comparison.
    """
    keyed = _keyed(df, strata, id_col, seed)
    sizes = checkpointed(keyed.groupBy("stratum", "digits").agg(F.count(F.lit(1)).alias("size")))
    counts = sizes.groupBy("stratum").agg(F.sum("size").alias("n"))
    q = quotas(counts).select(F.col("stratum").alias("q_stratum"), F.least("quota", "n").alias("quota"))
    upto = W.partitionBy("stratum").orderBy("digits").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        sizes.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .join(q, F.col("stratum").eqNullSafe(F.col("q_stratum")))
        .where((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("size")))
        .select(
            F.col("stratum").alias("e_stratum"),
            F.col("digits").alias("e_digits"),
            (F.col("quota") - F.col("before")).alias("rest"),
        )
    )
    inside = W.partitionBy("stratum", "digits").orderBy("key")
    cuts = (
        keyed.join(
            edge,
            F.col("stratum").eqNullSafe(F.col("e_stratum")) & (F.col("digits") == F.col("e_digits")),
        )
        .withColumn("place", F.row_number().over(inside))
        .where(F.col("place") == F.col("rest"))
        .select(F.col("stratum").alias("c_stratum"), F.col("key").alias("cut"))
    )
    return (
        df.join(cuts, F.col(strata).eqNullSafe(F.col("c_stratum")), "left")
        .withColumn(flag, F.coalesce(order_key(id_col, seed) <= F.col("cut"), F.lit(False)))
        .drop("c_stratum", "cut")
    )


def sample_simple(df: DataFrame, n: int, id_col: str = "review_id", seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) random rows; the cut-off reaches the scan as a scalar."""
    keyed = df.select(order_key(id_col, seed).alias("key")).withColumn(
        "digits", F.substring("key", 1, HASH_DIGITS)
    )
    everything = W.partitionBy(F.lit(1))
    upto = everything.orderBy("digits").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        keyed.groupBy("digits")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .withColumn("quota", F.least(F.lit(n), F.sum("size").over(everything)))
        .where((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("size")))
        .select(F.struct("digits", (F.col("quota") - F.col("before")).alias("rest")).alias("edge"))
        .scalar()
    )
    cut = (
        keyed.where(F.col("digits") == edge.getField("digits"))
        .withColumn("place", F.row_number().over(W.partitionBy("digits").orderBy("key")))
        .where(F.col("place") == edge.getField("rest"))
        .select("key")
        .scalar()
    )
    return df.where(order_key(id_col, seed) <= cut)


def sample_balanced(
    df: DataFrame,
    n_per_class: int | None = None,
    class_col: str = "sentiment",
    id_col: str = "review_id",
    seed: int = 42,
    strict: bool = False,
) -> DataFrame:
    """n rows of each class, by default as many as the smallest class has.

    ``strict`` refuses a class that is too small; otherwise such a class is taken whole.
    """
    if strict and n_per_class is not None:
        short = strata_counts(df, class_col).where(F.col("n") < n_per_class).limit(1).count()
        if short:
            raise ValueError(f"A class has fewer than {n_per_class} rows.")

    def quotas(counts: DataFrame) -> DataFrame:
        smallest = F.min("n").over(W.partitionBy(F.lit(1)))
        return counts.withColumn(
            "quota", smallest if n_per_class is None else F.lit(n_per_class).cast("long")
        )

    return mark_taken(df, class_col, quotas, id_col, seed).where("taken").drop("taken")


def sample_stratified(
    df: DataFrame, n: int, strata: str = "overall", id_col: str = "review_id", seed: int = 42
) -> DataFrame:
    """n rows that keep the shares of ``strata``."""
    share_out = lambda counts: largest_remainder(counts, F.lit(n))
    return mark_taken(df, strata, share_out, id_col, seed).where("taken").drop("taken")


def train_quotas(counts: DataFrame, test_fraction: float) -> DataFrame:
    """Training rows per stratum for a split of all rows."""
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    size = total - F.ceil(F.round(total * F.lit(test_fraction), 9))
    return largest_remainder(counts, size)


def split_stratified(
    df: DataFrame,
    test_fraction: float = 0.30,
    strata: str = "overall",
    id_col: str = "review_id",
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` = train / test, preserving the shares of ``strata``."""
    share_out = lambda counts: train_quotas(counts, test_fraction)
    marked = mark_taken(df, strata, share_out, id_col, seed, flag="_train")
    return marked.withColumn(
        "split", F.when(F.col("_train"), F.lit("train")).otherwise(F.lit("test"))
    ).drop("_train")


def rank_in_group(
    df: DataFrame, groups: Sequence[str], id_col: str = "review_id", seed: int = 42, rank: str = "rn"
) -> DataFrame:
    """1-based random rank within a group, ordered in hash slices instead of one task."""
    groups = list(groups)
    keyed = df.withColumn("_key", order_key(id_col, seed)).withColumn(
        "_digits", F.substring("_key", 1, HASH_DIGITS)
    )
    upto = W.partitionBy(*groups).orderBy("_digits").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups, "_digits")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(upto), F.lit(0)))
        .select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_digits").alias("_o_digits"), "_before")
    )
    inside = W.partitionBy(*groups, "_digits").orderBy("_key")
    same = F.col("_digits") == F.col("_o_digits")
    for g in groups:  # null is a group like any other
        same &= F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return (
        keyed.join(offsets, same)
        .drop("_o_digits", *[f"_o_{g}" for g in groups])
        .withColumn(rank, F.col("_before") + F.row_number().over(inside))
        .drop("_key", "_digits", "_before")
    )


def assign_folds(
    df: DataFrame,
    n_folds: int = 5,
    label: str = "sentiment",
    id_col: str = "review_id",
    seed: int = 42,
    fold: str = "fold",
) -> DataFrame:
    """Stratified folds: consecutive random ranks of a class go round the folds."""
    ranked = rank_in_group(df, [label], id_col, seed, rank="_rn")
    return ranked.withColumn(fold, F.pmod(F.col("_rn") - 1, F.lit(n_folds)).cast("int")).drop("_rn")


def renumber(small: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """Consecutive numbers from 0; for samples of a fixed small size only."""
    return small.withColumn(
        name, (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)) - 1).cast("int")
    )


def round_to_percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / whole, 1)
