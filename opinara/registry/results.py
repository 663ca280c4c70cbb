"""Saved results of a run, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import enhance as E
from opinara.operators import evaluate as V
from opinara.operators import generate as G
from opinara.operators.models import resolve_text_column
from opinara.registry.base import SQL_RATED, SQL_TEXTS, query, texts, with_
from opinara.registry.evaluation import SQL_EVALUATED, _long, _report
from opinara.registry.generation import SQL_PICKED, SQL_QUESTION
from opinara.registry.opinion import COLS, SQL_ENHANCED, enhanced_reviews
from opinara.registry.sampling import SQL_BASE, SQL_SPLIT, split_rows
from opinara.session import checkpointed, scratch_path
from opinara.sources import files
from opinara.sources import results as R
from opinara.sources.reviews import rated_reviews


def _path(spark, name: str) -> str:
    return scratch_path(spark, name.rpartition(".")[0]) + "." + name.rpartition(".")[2]


@query(
    "read_csv_upload",
    with_(SQL_TEXTS)
    + "SELECT review_id, coalesce(\"reviewText\", '') AS \"reviewText\", 'csv' AS source_format, 'reviewText' AS text_column, 'json' AS target_format FROM texts",
)
def read_csv_upload(spark, sf_dir):
    """An upload without a schema: format by name, types by inference, text column by rule."""
    path = _path(spark, "upload.CSV")
    files.write_frame(texts(spark, sf_dir), path, "csv")
    frame, fmt = files.read_upload(spark, path)
    column = resolve_text_column(frame.columns)
    return frame.select(
        F.col("review_id").cast("bigint").alias("review_id"),
        T.fill_text(column).alias("reviewText"),
        F.lit(fmt).alias("source_format"),
        F.lit(column).alias("text_column"),
        F.lit(files.output_format(fmt, " JSON ")).alias("target_format"),
    )


@query(
    "write_metrics",
    SQL_EVALUATED
    + 'SELECT model AS "Model", round(accuracy, 6) AS "Accuracy", round(precision_w, 6) AS "Precision", round(recall_w, 6) AS "Recall", round(f1_w, 6) AS "F1" FROM mm',
)
def write_metrics(spark, sf_dir):
    path = _path(spark, "metrics.csv")
    R.write_metrics(V.compare_models(_long(spark, sf_dir)), path)
    back = R.read_metrics(spark, path)
    return back.select("Model", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("Accuracy", "Precision", "Recall", "F1")])


@query("write_enhanced", SQL_ENHANCED + f"SELECT review_id, overall, {COLS} FROM enhanced_diff")
def write_enhanced(spark, sf_dir):
    path = _path(spark, "enhanced.csv")
    R.write_enhanced(enhanced_reviews(spark, sf_dir).select("review_id", "overall", *E.ENHANCED_COLUMNS), path)
    back = files.read_csv(spark, path, line_breaks=False)
    return back.select(
        F.col("review_id").cast("bigint").alias("review_id"),
        *[F.col(c).cast("double").alias(c) for c in ("overall", *E.ENHANCED_COLUMNS)],
    )


@query(
    "parse_class_report",
    SQL_EVALUATED
    + ", entries AS (SELECT model, label AS row, support FROM cm UNION ALL SELECT model, 'accuracy', n FROM mm UNION ALL SELECT model, 'macro avg', n FROM mm UNION ALL SELECT model, 'weighted avg', n FROM mm) "
    "SELECT model, concat('  ', row, ' ', support) AS line FROM entries",
)
def parse_class_report(spark, sf_dir):
    """The report as text: a line with the model's name opens its section."""
    path = scratch_path(spark, "report")
    rows = _report(V.classification_report(_long(spark, sf_dir)))
    lines = F.array_sort(F.collect_list(F.concat(F.lit("  "), "row", F.lit(" "), "support")))
    sections = rows.groupBy("model").agg(F.concat(F.col("model"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("value"))
    sections.select("value").write.text(path)  # a few models with a few lines each
    return R.read_class_report(spark, path).select("model", "line")


def _metadata(spark, sf_dir):
    rated = rated_reviews(spark, sf_dir).select("review_id", "overall")
    split = checkpointed(split_rows(spark, sf_dir))
    comparison = V.compare_models(_long(spark, sf_dir))
    summary = E.enhancement_summary(enhanced_reviews(spark, sf_dir))
    best = {"nb": ({"smoothing": "1.0"}, 0.5), "mlp": ({"layers": "[32]", "maxIter": "200"}, 0.25)}
    return R.run_metadata(rated, split, comparison, summary, best)


@query(
    "run_metadata",
    with_(SQL_RATED, SQL_BASE, SQL_SPLIT)
    + "SELECT (SELECT count(*) FROM rated) AS dataset_rows, count(*) AS subset_rows, count(*) FILTER (WHERE split = 'train') AS train_rows, "
    "count(*) FILTER (WHERE split = 'test') AS test_rows, count(*) FILTER (WHERE split = 'train' AND sentiment = 'Positive') AS train_positive, "
    "count(*) FILTER (WHERE split = 'test' AND overall = 2) AS test_two_stars, 42::BIGINT AS seed, '200' AS mlp_iterations, 0.70::DOUBLE AS base_weight, 2::BIGINT AS n_models FROM split",
)
def run_metadata(spark, sf_dir):
    """The nested record, saved as JSON and read back."""
    path = scratch_path(spark, "metadata")
    R.write_metadata(_metadata(spark, sf_dir), path)
    return R.read_metadata(spark, path).select(
        "dataset_rows",
        "subset_rows",
        "train_rows",
        "test_rows",
        F.col("train_class_distribution.Positive").alias("train_positive"),
        F.col("test_rating_distribution")["2.0"].alias("test_two_stars"),
        F.col("config.random_state").alias("seed"),
        F.col("mlp_best_params.maxIter").alias("mlp_iterations"),
        F.col("rating_enhancement_method.base_rating_weight").alias("base_weight"),
        F.size("results").cast("bigint").alias("n_models"),
    )


@query(
    "default_missing",
    with_(SQL_RATED)
    + f"SELECT CAST(count(*) AS VARCHAR) AS dataset_rows, '{R.MISSING}' AS notes, '{R.MISSING}' AS rouge, true AS payload_absent FROM rated",
)
def default_missing(spark, sf_dir):
    """Fields of a saved record, with the fallback for null and unknown ones."""
    path = scratch_path(spark, "partial")
    rated = rated_reviews(spark, sf_dir).agg(F.count("*").alias("dataset_rows"))
    rated.withColumn("notes", F.lit(None).cast("string")).write.option("ignoreNullFields", False).json(path)
    saved = R.read_metadata(spark, path)
    absent = R.read_optional(spark, scratch_path(spark, "never-written")) is None
    return saved.select(*[R.field_or_default(saved, n) for n in ("dataset_rows", "notes", "rouge")], F.lit(absent).alias("payload_absent"))


@query(
    "llm_payload",
    with_(SQL_TEXTS, *SQL_PICKED, SQL_QUESTION)
    + "SELECT p.review_index, p.word_count, p.\"reviewText\" AS original_text, upper(p.\"reviewText\"[:20]) AS summary, "
    "(SELECT count(*) FROM picked) AS n_selected, (SELECT word_count FROM question) AS question_words FROM picked p",
)
def llm_payload(spark, sf_dir):
    """The payload of given summaries and a given reply, saved as JSON and read back."""
    path = scratch_path(spark, "payload")
    picked = G.summary_reviews(texts(spark, sf_dir)).withColumn("summary", F.upper(F.substring("reviewText", 1, 20)))
    question = G.first_row(G.question_reviews(texts(spark, sf_dir)))
    reply = question.withColumn("response", F.lit("thanks")).withColumn("overall", F.lit(2.0))
    R.write_generation_payload(G.generation_payload(picked, reply, "given", -1, 42), path)
    saved = spark.read.json(path)
    one = saved.select(
        F.inline("summary_task.all_reviews"),
        F.col("summary_task.selected_reviews_count").alias("n_selected"),
        F.col("service_response_task.selected_review.word_count").alias("question_words"),
    )
    return one.select(
        F.col("review_index").cast("int").alias("review_index"),
        F.col("word_count").cast("int").alias("word_count"),
        "original_text",
        "summary",
        "n_selected",
        F.col("question_words").cast("int").alias("question_words"),
    )


@query(
    "timestamp_string",
    "SELECT doc_id AS review_id, strftime(make_timestamp(doc_id * 86400000000), '%Y-%m-%d %H:%M:%S') AS at FROM documents",
)
def timestamp_string(spark, sf_dir):
    from opinara.functions.scores import timestamp_string as as_text
    from opinara.sources.reviews import documents

    return documents(spark, sf_dir).select("review_id", as_text(F.timestamp_seconds("unixReviewTime")).alias("at"))

