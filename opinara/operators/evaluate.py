"""Classification metrics from one grouped count per (model, truth, prediction)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opinara.functions import constants as C


def long_predictions(df: DataFrame, truth: str, models: Mapping[str, str], id_col: str = "review_id") -> DataFrame:
    """(id, model_order, model, truth, pred): all models on the same rows, read once."""
    entries = [
        F.struct(F.lit(i).alias("model_order"), F.lit(name).alias("model"), F.col(c).alias("pred"))
        for i, (name, c) in enumerate(models.items())
    ]
    return df.select(id_col, F.col(truth).alias("truth"), F.inline(F.array(*entries)))


def confusion_cells(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model_order", "model", "truth", "pred").agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """All class pairs per model, alphabetical, zero cells present."""
    labels = F.array(*[F.lit(c) for c in C.CLASSES])
    grid = (
        cells.select("model_order", "model")
        .distinct()
        .withColumn("truth", F.explode(labels))
        .withColumn("pred", F.explode(labels))
    )
    return (
        grid.join(cells, ["model_order", "model", "truth", "pred"], "left")
        .select("model_order", "model", "truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        .orderBy("model_order", "truth", "pred")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(cells: DataFrame) -> DataFrame:
    """Per model and class: support, predicted count, precision, recall, f1."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("pred").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    sums = (
        cells.select("model_order", "model", F.inline(parts))
        .groupBy("model_order", "model", "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return sums.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def _weighted(name: str) -> Column:
    return F.sum(F.col("support") * F.col(name)) / F.sum("support")


def model_metrics(metrics: DataFrame) -> DataFrame:
    """One row per model from `class_metrics`."""
    return metrics.groupBy("model_order", "model").agg(
        F.sum("support").alias("n"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"),
        _weighted("f1").alias("f1"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def compare_models(predictions: DataFrame) -> DataFrame:
    return model_metrics(class_metrics(confusion_cells(predictions))).orderBy("model_order")


def best_model(comparison: DataFrame) -> DataFrame:
    """Highest weighted f1, first model on ties."""
    return comparison.orderBy(F.desc("f1"), F.asc("model_order")).limit(1)


def classification_report(predictions: DataFrame) -> DataFrame:
    """Class rows followed by accuracy, macro and weighted rows."""
    metrics = class_metrics(confusion_cells(predictions))
    classes = metrics.select(
        "model_order", "model", F.col("label").alias("row"), "precision", "recall", "f1", "support"
    )
    summary = model_metrics(metrics).select(
        "model_order",
        "model",
        F.inline(
            F.array(
                _summary_row("accuracy", "accuracy", "accuracy", "accuracy"),
                _summary_row("macro avg", "precision_macro", "recall_macro", "f1_macro"),
                _summary_row("weighted avg", "precision", "recall", "f1"),
            )
        ),
    )
    return classes.unionByName(summary)


def _summary_row(name: str, precision: str, recall: str, f1: str) -> Column:
    return F.struct(
        F.lit(name).alias("row"),
        F.col(precision).alias("precision"),
        F.col(recall).alias("recall"),
        F.col(f1).alias("f1"),
        F.col("n").alias("support"),
    )


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    return counts.withColumn("share", F.col(n) / F.sum(n).over(W.partitionBy(F.lit(1))))
