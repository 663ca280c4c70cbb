"""Exact order statistics without gathering a column in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opinara.session import checkpointed

# Distinct values that one window may order.
PIECE_ROWS = 50_000


def value_counts_by(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, n): one row per distinct value, counted before the shuffle."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*groups, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of keys with their prefixed twins."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def exact_quantiles(
    counts: DataFrame, groups: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """(groups, prob, q) with linear interpolation, from `value_counts_by` output.

    ``counts`` is read several times, so pass a written table.  Approximate cut points split
    each group's distinct values into ranges of about ``PIECE_ROWS`` values.  They steer only
    the balance: ranks are exact sums of counts.  Just the ranges that contain a wanted rank
    are ordered, each in its own window.
    """
    groups = list(groups)
    pieces = 1 + counts.count() // PIECE_ROWS
    cuts = F.percentile_approx("value", F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(10_000))
    meta = counts.groupBy(*groups).agg(
        (cuts if pieces > 1 else F.array().cast("array<double>")).alias("cuts"), F.sum("n").alias("total")
    )
    keys = [F.col(g).alias(f"_m_{g}") for g in groups]
    meta = meta.select(*keys, "cuts", "total")
    placed = counts.join(meta, _same(groups, "_m_")).drop(*[f"_m_{g}" for g in groups]).withColumn(
        "piece", F.size(F.filter("cuts", lambda c: c < F.col("value")))
    )
    wanted = F.array(
        *[
            F.struct(F.lit(float(p)).alias("prob"), ((F.col("total") - 1) * F.lit(float(p))).alias("at"))
            for p in probs
        ]
    )
    upto = W.partitionBy(*groups).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        placed.groupBy(*groups, "piece", "total")
        .agg(F.sum("n").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .withColumn("want", F.explode(wanted))
        .where(
            (F.ceil("want.at") >= F.col("before"))
            & (F.floor("want.at") < F.col("before") + F.col("size"))
        )
        .groupBy(*groups, "piece", "before")
        .agg(F.collect_list("want").alias("wants"))
        .select(*[F.col(g).alias(f"_p_{g}") for g in groups], F.col("piece").alias("_p_piece"), "before", "wants")
    )
    inside = W.partitionBy(*groups, "piece").orderBy("value")
    ranked = (
        placed.select(*groups, "piece", "value", "n")
        .join(ranges, _same([*groups, "piece"], "_p_"))
        .withColumn("last", F.col("before") + F.sum("n").over(inside))
        .withColumn("first", F.col("last") - F.col("n"))
        .withColumn("want", F.explode("wants"))
    )
    low, high = F.floor("want.at"), F.ceil("want.at")
    here = lambda k: (F.col("first") <= k) & (k < F.col("last"))
    return (
        ranked.where(here(low) | here(high))
        .groupBy(*groups, F.col("want.prob").alias("prob"), F.col("want.at").alias("at"))
        .agg(
            F.max(F.when(here(low), F.col("value"))).alias("v0"),
            F.max(F.when(here(high), F.col("value"))).alias("v1"),
        )
        .select(
            *groups,
            "prob",
            (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.floor("at"))).alias("q"),
        )
    )


def describe_by(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of ``value`` per group.

    The input is read once, for its value counts; everything else comes from that table.
    Groups without a value are kept with count 0.
    """
    groups = list(groups)
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    counts = checkpointed(
        df.groupBy(*groups, number.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    filled = counts.where("value is not null")
    means = counts.groupBy(*groups).agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("count"),
        (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    centre = means.select(*[F.col(g).alias(f"_c_{g}") for g in groups], F.col("mean").alias("_mean"))
    off = F.col("value") - F.col("_mean")
    spread = filled.join(centre, _same(groups, "_c_")).groupBy(*groups).agg(
        F.when(F.sum("n") > 1, F.sqrt(F.sum(F.col("n") * off * off) / (F.sum("n") - 1))).alias("std")
    )
    quartiles = (
        exact_quantiles(filled, groups, (0.25, 0.5, 0.75))
        .groupBy(*groups)
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("q"))).alias(name)
                for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
            ]
        )
    )
    out = means
    for prefix, table in (("_s_", spread), ("_q_", quartiles)):
        named = table.select(*[F.col(c).alias(f"{prefix}{c}") if c in groups else F.col(c) for c in table.columns])
        out = out.join(named, _same(groups, prefix), "left").drop(*[f"{prefix}{g}" for g in groups])
    return out.select(*groups, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column, fully null ones included unless the table is empty."""
    named = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return describe_by(df.select(F.inline(named)), ["column"], "value")
