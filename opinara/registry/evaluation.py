"""Metrics of the scorers on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.operators import evaluate as V
from opinara.operators import lexicon as L
from opinara.registry.base import (
    SQL_LEXICON,
    SQL_RATED,
    SQL_SENTIMENT,
    cleaned,
    query,
    sql_cleaned,
    sql_label,
    sql_scores,
    with_,
)
from opinara.registry.features import SQL_BAYES, bayes_predictions
from opinara.session import checkpointed
from opinara.sources.lexicon import built_in_lexicon
from opinara.sources.reviews import rated_reviews


def lexicon_predictions(spark, sf_dir):
    """(review_id, sentiment, vader, textblob) for every rated review."""
    rows = cleaned(rated_reviews(spark, sf_dir).select("review_id", "overall", "reviewText")).select(
        "review_id", "overall", "cleaned_text"
    )
    scored = L.lexicon_scores(rows, built_in_lexicon(spark), "cleaned_text", keep=["overall"], bounded=True)
    return L.predict_from_scores(scored).withColumn(
        "sentiment", S.label_sentiment(F.col("overall"))
    ).select("review_id", "sentiment", "vader", "textblob")


MODELS = {"VADER": "vader", "TextBlob": "textblob"}


def _long(spark, sf_dir):
    return V.long_predictions(lexicon_predictions(spark, sf_dir), "sentiment", MODELS)


SQL_PREDICTED = (
    sql_cleaned("rated", "overall"),
    sql_scores("cleaned", "cleaned_text", "overall"),
    f"predicted AS (SELECT review_id, {SQL_SENTIMENT} AS sentiment, {sql_label('compound', C.COMPOUND_THRESHOLD)} AS vader, {sql_label('polarity', 0)} AS textblob FROM scored)",
)
SQL_LONG = (
    "long AS (SELECT review_id, 0 AS model_order, 'VADER' AS model, sentiment AS truth, vader AS pred FROM predicted "
    "UNION ALL SELECT review_id, 1, 'TextBlob', sentiment, textblob FROM predicted)"
)
SQL_METRICS = (
    "classes AS (SELECT DISTINCT model_order, model, truth AS label FROM long UNION SELECT DISTINCT model_order, model, pred FROM long)",
    "per_class AS (SELECT c.model_order, c.model, c.label, count(*) FILTER (WHERE truth = label) AS support, "
    "count(*) FILTER (WHERE pred = label) AS predicted_n, count(*) FILTER (WHERE pred = label AND truth = label) AS hits "
    "FROM classes c JOIN long l ON c.model = l.model GROUP BY ALL)",
    "pr AS (SELECT *, CASE WHEN predicted_n = 0 THEN 0.0 ELSE hits / predicted_n::DOUBLE END AS precision_, CASE WHEN support = 0 THEN 0.0 ELSE hits / support::DOUBLE END AS recall_ FROM per_class)",
    "cm AS (SELECT *, CASE WHEN precision_ + recall_ = 0 THEN 0.0 ELSE 2 * precision_ * recall_ / (precision_ + recall_) END AS f1_ FROM pr)",
    "mm AS (SELECT model_order, model, CAST(sum(support) AS BIGINT) AS n, sum(hits)::DOUBLE / sum(support) AS accuracy, "
    "sum(support * precision_) / sum(support) AS precision_w, sum(support * recall_) / sum(support) AS recall_w, sum(support * f1_) / sum(support) AS f1_w, "
    "avg(precision_) AS precision_m, avg(recall_) AS recall_m, avg(f1_) AS f1_m FROM cm GROUP BY model_order, model)",
)
SQL_EVALUATED = with_(SQL_RATED, SQL_LEXICON, *SQL_PREDICTED, SQL_LONG, *SQL_METRICS)


@query(
    "confusion_matrix",
    SQL_EVALUATED
    + ", labels(l) AS (VALUES ('Negative'), ('Neutral'), ('Positive')), "
    "grid AS (SELECT m.model_order, m.model, a.l AS truth, b.l AS pred FROM mm m, labels a, labels b) "
    "SELECT g.model_order, g.model, g.truth, g.pred, count(review_id) AS n FROM grid g LEFT JOIN long USING (model_order, model, truth, pred) GROUP BY ALL",
)
def confusion_matrix(spark, sf_dir):
    return V.confusion_matrix(V.confusion_cells(_long(spark, sf_dir)))


def _metric(name, column, sql_column):
    @query(name, SQL_EVALUATED + f"SELECT model, round({sql_column}, 6) AS {column} FROM mm")
    def run(spark, sf_dir):
        return V.compare_models(_long(spark, sf_dir)).select(
            "model", F.round(column, 6).alias(column)
        )


_metric("accuracy", "accuracy", "accuracy")
_metric("precision_weighted", "precision", "precision_w")
_metric("recall_weighted", "recall", "recall_w")
_metric("f1_weighted", "f1", "f1_w")
_metric("f1_macro", "f1_macro", "f1_m")

_ROW = ["accuracy", "precision", "recall", "f1"]
_SQL_ROW = "round(accuracy, 6) AS accuracy, round(precision_w, 6) AS precision, round(recall_w, 6) AS recall, round(f1_w, 6) AS f1"


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in _ROW])


@query("evaluate", SQL_EVALUATED + f"SELECT model, n, {_SQL_ROW} FROM mm WHERE model = 'VADER'")
def evaluate(spark, sf_dir):
    one = V.long_predictions(lexicon_predictions(spark, sf_dir), "sentiment", {"VADER": "vader"})
    return _rounded(V.compare_models(one), "model", "n")


SQL_COMPARED = with_(
    *SQL_BAYES,
    SQL_LEXICON,
    sql_scores("cleaned", "cleaned_text"),
    f"predicted AS (SELECT s.review_id, t.sentiment, {sql_label('compound', C.COMPOUND_THRESHOLD)} AS vader, {sql_label('polarity', 0)} AS textblob, nb_sentiment FROM scored s JOIN tagged t USING (review_id) JOIN nb USING (review_id))",
    SQL_LONG[:-1] + " UNION ALL SELECT review_id, 2, 'Naive Bayes', sentiment, nb_sentiment FROM predicted)",
    *SQL_METRICS,
)


def test_predictions(spark, sf_dir):
    """Test rows with the labels of both lexicon scores and of naive Bayes."""
    bayes = bayes_predictions(spark, sf_dir).select("review_id", "nb_sentiment")
    return lexicon_predictions(spark, sf_dir).join(bayes, "review_id")


def _compared(spark, sf_dir):
    models = {**MODELS, "Naive Bayes": "nb_sentiment"}
    return V.long_predictions(test_predictions(spark, sf_dir), "sentiment", models)


@query("compare_models", SQL_COMPARED + f"SELECT model_order, model, n, {_SQL_ROW} FROM mm")
def compare_models(spark, sf_dir):
    return _rounded(V.compare_models(_compared(spark, sf_dir)), "model_order", "model", "n")


SQL_TRAIN_METRICS = with_(
    *[x.replace("WHERE split = 'test' GROUP BY", "WHERE split = 'train' GROUP BY") for x in SQL_BAYES],
    "long AS (SELECT review_id, 0 AS model_order, 'Naive Bayes' AS model, sentiment AS truth, nb_sentiment AS pred FROM nb JOIN tagged USING (review_id))",
    *SQL_METRICS,
)


@query("train_metrics_nb", SQL_TRAIN_METRICS + f"SELECT model, n, {_SQL_ROW} FROM mm")
def train_metrics_nb(spark, sf_dir):
    """Naive Bayes on the rows it was fitted to."""
    rows = bayes_predictions(spark, sf_dir, part="train")
    long = V.long_predictions(rows, "sentiment", {"Naive Bayes": "nb_sentiment"})
    return _rounded(V.compare_models(long), "model", "n")


@query(
    "best_model",
    SQL_COMPARED + f"SELECT model, {_SQL_ROW} FROM mm ORDER BY f1_w DESC, model_order LIMIT 1",
)
def best_model(spark, sf_dir):
    return _rounded(V.best_model(V.compare_models(_compared(spark, sf_dir))), "model")


@query(
    "top1_by_metric",
    SQL_EVALUATED + f"SELECT model, {_SQL_ROW} FROM mm ORDER BY f1_w DESC, model_order LIMIT 1",
)
def top1_by_metric(spark, sf_dir):
    return _rounded(V.best_model(V.compare_models(_long(spark, sf_dir))), "model")


_REPORT_SQL = (
    "SELECT model, label AS row, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1_, 6) AS f1, support FROM cm "
    "UNION ALL SELECT model, 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), n FROM mm "
    "UNION ALL SELECT model, 'macro avg', round(precision_m, 6), round(recall_m, 6), round(f1_m, 6), n FROM mm "
    "UNION ALL SELECT model, 'weighted avg', round(precision_w, 6), round(recall_w, 6), round(f1_w, 6), n FROM mm"
)


def _report(df):
    return df.select(
        "model", "row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query("classification_report", SQL_EVALUATED + _REPORT_SQL)
def classification_report(spark, sf_dir):
    return _report(V.classification_report(_long(spark, sf_dir)))


@query("write_class_report", SQL_COMPARED + _REPORT_SQL)
def write_class_report(spark, sf_dir):
    """The report table of all scorers, written to the shared folder and read back."""
    from opinara.session import scratch_path

    path = scratch_path(spark, "class-report")
    _report(V.classification_report(_compared(spark, sf_dir))).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "zip_predictions",
    with_(SQL_RATED, SQL_LEXICON, *SQL_PREDICTED)
    + "SELECT review_id, vader, textblob FROM predicted",
)
def zip_predictions(spark, sf_dir):
    """Predictions scored separately are paired by key."""
    both = checkpointed(lexicon_predictions(spark, sf_dir))
    return both.select("review_id", "vader").join(both.select("review_id", "textblob"), "review_id")


@query(
    "ensemble_final",
    with_(SQL_RATED, SQL_LEXICON, *SQL_PREDICTED)
    + "SELECT review_id, CASE WHEN vader <> textblob THEN textblob ELSE vader END AS final_sentiment, vader = textblob AS models_agree FROM predicted",
)
def ensemble_final(spark, sf_dir):
    """The serving rule applied to two label columns."""
    first, second = F.col("vader"), F.col("textblob")
    return lexicon_predictions(spark, sf_dir).select(
        "review_id",
        S.final_label(first, second).alias("final_sentiment"),
        (first == second).alias("models_agree"),
    )
