"""Saved results of a run: metrics, enhanced ratings, reports, metadata, payloads."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opinara.config import RunConfig
from opinara.functions.scores import run_timestamp
from opinara.sources.files import read_csv, write_frame

MISSING = "Not saved in this run"
REPORT_MODELS = ("VADER", "TextBlob", "Naive Bayes", "MLP")


def write_metrics(comparison: DataFrame, path: str) -> None:
    """One row per model, as CSV."""
    named = comparison.select(
        F.col("model").alias("Model"),
        F.col("accuracy").alias("Accuracy"),
        F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"),
        F.col("f1").alias("F1"),
    )
    write_frame(named, path, "csv")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path)


def write_enhanced(enhanced: DataFrame, path: str, fmt: str = "csv") -> None:
    write_frame(enhanced, path, fmt)


def counts_map(df: DataFrame, column: str) -> Column:
    """Scalar map value -> rows; the column has a handful of values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.collect_list(F.struct(F.col(column).cast("string").alias("k"), F.col("n").alias("v")))
    return counts.agg(F.map_from_entries(F.array_sort(entries))).scalar()


def _text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(str(x)) for pair in sorted(values.items()) for x in pair])


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def run_metadata(
    data: DataFrame,
    split: DataFrame,
    comparison: DataFrame,
    enhanced_summary: DataFrame,
    best: dict[str, tuple[dict[str, str], float]],
    config: RunConfig = RunConfig(),
) -> DataFrame:
    """The nested record of a run as one row.

    ``split`` holds split, sentiment and overall of the subset; ``best`` maps "nb" and
    "mlp" to (parameters, cross-validated f1).
    """
    train, test = (split.where(F.col("split") == part) for part in ("train", "test"))
    settings = asdict(config)
    weights = settings["enhance"]
    results = comparison.agg(
        F.array_sort(F.collect_list(F.struct("model_order", "model", "accuracy", "precision", "recall", "f1")))
    ).scalar()
    return enhanced_summary.select(
        F.struct(
            F.lit(config.n_per_class).alias("n_per_class"),
            F.lit(config.seed).alias("random_state"),
            *[F.lit(v).alias(k) for k, v in weights.items()],
        ).alias("config"),
        run_timestamp().alias("generated_at"),
        _count(data).alias("dataset_rows"),
        _count(split).alias("subset_rows"),
        _count(train).alias("train_rows"),
        _count(test).alias("test_rows"),
        *[
            counts_map(part, column).alias(f"{name}_{label}_distribution")
            for name, part in (("subset", split), ("train", train), ("test", test))
            for column, label in (("sentiment", "class"), ("overall", "rating"))
        ],
        *[
            value.alias(name)
            for model in ("nb", "mlp")
            for value, name in (
                (_text_map(best[model][0]), f"{model}_best_params"),
                (F.lit(float(best[model][1])), f"{model}_best_cv_f1"),
            )
        ],
        F.struct(F.lit("confidence_weighted").alias("name"), *[F.lit(v).alias(k) for k, v in weights.items()]).alias(
            "rating_enhancement_method"
        ),
        F.struct(*enhanced_summary.columns).alias("rating_enhancement_summary"),
        results.alias("results"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved JSON result, or None where it was never written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path)
    except AnalysisException:
        return None


def field_or_default(metadata: DataFrame, name: str, default: str = MISSING) -> Column:
    """A metadata field as text, with a fallback for absent or null fields."""
    if name not in metadata.columns:
        return F.lit(default).alias(name)
    column = F.col(name)
    is_nested = metadata.schema[name].dataType.simpleString().startswith(("struct", "map", "array"))
    text = F.to_json(column) if is_nested else column.cast("string")
    return F.coalesce(text, F.lit(default)).alias(name)


def parse_class_report(lines: DataFrame, models: tuple[str, ...] = REPORT_MODELS) -> DataFrame:
    """(model, line_no, line) from report text given as (line_no, line).

    A line that is exactly a model name opens its section.  A report has a few dozen
    lines, so one ordered window is enough.
    """
    header = F.when(F.trim("line").isin(*models), F.trim("line"))
    so_far = W.partitionBy(F.lit(1)).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return (
        lines.withColumn("header", header)
        .withColumn("model", F.last("header", ignorenulls=True).over(so_far))
        .where(F.col("header").isNull() & F.col("model").isNotNull() & (F.trim("line") != ""))
        .select("model", "line_no", "line")
    )


def read_class_report(spark: SparkSession, path: str) -> DataFrame:
    """Report text file to (model, line_no, line)."""
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")
    )
    return parse_class_report(lines)


def write_generation_payload(payload: DataFrame, path: str) -> None:
    payload.write.mode("overwrite").json(path)
