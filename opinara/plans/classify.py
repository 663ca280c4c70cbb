"""Batch classification of a CSV or JSON file or folder."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from opinara.operators.models import classify_frame, resolve_text_column
from opinara.sources.files import output_format, read_upload, write_frame


def classify_path(
    spark: SparkSession,
    model: PipelineModel | str,
    source: str,
    target: str,
    text_column: str | None = None,
    requested_format: str | None = None,
) -> str:
    """Read, append predictions, write; returns the text column used.  No shuffle."""
    fitted = PipelineModel.load(model) if isinstance(model, str) else model
    frame, fmt = read_upload(spark, source)
    column = resolve_text_column(frame.columns, text_column)
    write_frame(classify_frame(frame, fitted, column), target, output_format(fmt, requested_format))
    return column
