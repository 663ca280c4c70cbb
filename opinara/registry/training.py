"""Model fitting and classification; checked by row counts because solvers differ."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.config import RunConfig
from opinara.functions import constants as C
from opinara.operators import evaluate as V
from opinara.operators import models as M
from opinara.registry.base import SQL_RATED, query, sql_cleaned, with_
from opinara.registry.features import SQL_BAYES, SQL_LIMITS, SQL_NUMERIC, SQL_SCALED, sql_doc_terms, sql_vocabulary, sql_weights, train_features
from opinara.registry.sampling import ORDER, SQL_BASE, SQL_SPLIT, split_rows
from opinara.session import scratch_path
from opinara.sources.reviews import documents

# The full search space; candidates and folds are fitted side by side.
CONFIG = RunConfig(parallelism=8)


def split_documents(spark, sf_dir, part):
    ids = split_rows(spark, sf_dir).where(F.col("split") == part).select("review_id", "sentiment")
    return documents(spark, sf_dir).select("review_id", "reviewText").join(ids, "review_id")


@cache
def _trained(application: str, sf_dir: str):
    spark = SparkSession.getActiveSession()
    return M.train_models(split_documents(spark, sf_dir, "train"), config=CONFIG)


def trained(spark, sf_dir):
    """Models of one session and data set are fitted once."""
    return _trained(spark.sparkContext.applicationId, sf_dir)


_ALPHAS = ", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(CONFIG.nb_alphas))


def _by_class(form: str) -> str:
    return ", ".join(form.format(c=c) for c in C.CLASSES)


# The grid by formula: masses of all folds but one, for every smoothing value.
SQL_NB_GRID = (
    SQL_RATED,
    SQL_BASE,
    SQL_SPLIT,
    "learned AS (SELECT r.review_id, r.\"reviewText\", s.sentiment FROM rated r JOIN split s USING (review_id) WHERE s.split = 'train')",
    sql_cleaned("learned", "sentiment"),
    SQL_NUMERIC,
    SQL_LIMITS,
    SQL_SCALED,
    sql_doc_terms("cleaned", "sentiment"),
    sql_vocabulary("cleaned"),
    sql_weights("sentiment"),
    f"folds AS (SELECT review_id, sentiment, (row_number() OVER (PARTITION BY sentiment ORDER BY {ORDER}) - 1) % {CONFIG.n_folds} AS fold FROM cleaned)",
    "numerics AS (UNPIVOT scaled ON review_length, exclamation_count, uppercase_count INTO NAME feature VALUE weight)",
    "x AS (SELECT f.fold, f.review_id, f.sentiment, term, weight FROM weights JOIN folds f USING (review_id) UNION ALL "
    "SELECT f.fold, f.review_id, f.sentiment, '<' || feature || '>', weight FROM numerics JOIN folds f USING (review_id))",
    "own AS (SELECT fold, term, " + _by_class("sum(CASE WHEN sentiment = '{c}' THEN weight ELSE 0.0 END) AS m_{c}") + " FROM x GROUP BY ALL)",
    "every AS (SELECT term, " + _by_class("sum(m_{c}) AS m_{c}") + " FROM own GROUP BY term)",
    f"fold_list(fold) AS (SELECT unnest(range({CONFIG.n_folds})))",
    "mass AS (SELECT l.fold, e.term, " + _by_class("e.m_{c} - coalesce(o.m_{c}, 0.0) AS m_{c}") + " FROM every e CROSS JOIN fold_list l LEFT JOIN own o ON o.term = e.term AND o.fold = l.fold)",
    "tot AS (SELECT fold, " + _by_class("sum(m_{c}) AS t_{c}") + " FROM mass GROUP BY fold)",
    "dims AS (SELECT count(*) + 3 AS d FROM vocabulary)",
    f"alphas(candidate, alpha) AS (VALUES {_ALPHAS})",
    "theta AS (SELECT candidate, fold, term, " + _by_class("ln((m_{c} + alpha) / (t_{c} + alpha * d)) AS th_{c}") + " FROM mass JOIN tot USING (fold), dims, alphas)",
    "prior AS (SELECT l.fold, " + _by_class("ln(count(*) FILTER (WHERE sentiment = '{c}') / count(*)::DOUBLE) AS p_{c}") + " FROM fold_list l JOIN folds f ON f.fold <> l.fold GROUP BY l.fold)",
    "sums AS (SELECT candidate, x.fold, review_id, any_value(sentiment) AS truth, " + _by_class("any_value(p_{c}) + sum(weight * th_{c}) AS s_{c}") + " FROM x JOIN theta USING (fold, term) JOIN prior p ON p.fold = x.fold GROUP BY ALL)",
    "labelled AS (SELECT candidate, fold, truth, CASE WHEN s_Negative >= s_Neutral AND s_Negative >= s_Positive THEN 'Negative' WHEN s_Neutral >= s_Positive THEN 'Neutral' ELSE 'Positive' END AS pred FROM sums)",
    "per_class AS (SELECT candidate, fold, c AS label, count(*) AS n, count(*) FILTER (WHERE truth = c) AS support, count(*) FILTER (WHERE pred = c) AS predicted, count(*) FILTER (WHERE truth = c AND pred = c) AS hits "
    f"FROM labelled CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in C.CLASSES)}) k(c) GROUP BY ALL)",
    "scored AS (SELECT candidate, fold, sum(support * CASE WHEN hits = 0 THEN 0.0 ELSE 2.0 * hits / (support + predicted) END) / any_value(n) AS f1 FROM per_class GROUP BY ALL)",
    "grid AS (SELECT candidate, any_value(alpha) AS alpha, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1 FROM scored JOIN alphas USING (candidate) GROUP BY candidate)",
)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "train_nb",
    with_(*SQL_NB_GRID)
    + "SELECT 'Naive Bayes' AS model, candidate, 'smoothing=' || alpha AS params, round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, "
    "row_number() OVER (ORDER BY round(mean_f1, 9) DESC, candidate) = 1 AS is_best FROM grid",
)
def train_nb(spark, sf_dir):
    return _rounded(M.grid_results(trained(spark, sf_dir).bayes, "Naive Bayes"), "mean_f1", "std_f1")


@query("train_mlp")
def train_mlp(spark, sf_dir):
    return M.grid_results(trained(spark, sf_dir).perceptron, "MLP")


@query("grid_search_cv")
def grid_search_cv(spark, sf_dir):
    fitted = trained(spark, sf_dir)
    return M.grid_results(fitted.bayes, "Naive Bayes").unionByName(
        M.grid_results(fitted.perceptron, "MLP")
    )


@query(
    "nb_grid_curve",
    with_(*SQL_NB_GRID)
    + "SELECT alpha, round(mean_f1, 6) AS mean_f1, round(mean_f1 - std_f1, 6) AS low, round(mean_f1 + std_f1, 6) AS high FROM grid",
)
def nb_grid_curve(spark, sf_dir):
    return _rounded(M.bayes_curve(trained(spark, sf_dir).bayes), "mean_f1", "low", "high")


@query("loss_curve")
def loss_curve(spark, sf_dir):
    return M.loss_curve(trained(spark, sf_dir).perceptron)


@query("assemble")
def assemble(spark, sf_dir):
    """Vector size and stored entries of every document."""
    df = documents(spark, sf_dir).select("review_id", "reviewText")
    return M.feature_matrix(trained(spark, sf_dir).features, df)


@query("stack_features")
def stack_features(spark, sf_dir):
    df = split_documents(spark, sf_dir, "test")
    return M.feature_matrix(trained(spark, sf_dir).features, df)


@query("predict")
def predict(spark, sf_dir):
    test = split_documents(spark, sf_dir, "test")
    return M.classify_frame(test, trained(spark, sf_dir).model).drop("reviewText")


@query("classify_frame")
def classify_frame(spark, sf_dir):
    df = documents(spark, sf_dir).select("review_id", F.col("reviewText").alias("text"))
    return M.classify_frame(df, trained(spark, sf_dir).model).drop("text")


@query("load_model")
def load_model(spark, sf_dir):
    """The saved model, read back, classifies the test rows."""
    path = scratch_path(spark, "model")
    trained(spark, sf_dir).model.write().overwrite().save(path)
    test = split_documents(spark, sf_dir, "test")
    return M.classify_frame(test, PipelineModel.load(path)).drop("reviewText")


MODELS = {"Naive Bayes": "nb_sentiment", "MLP": "mlp_sentiment"}


@query("train_metrics")
def train_metrics(spark, sf_dir):
    rows = M.classify_frame(split_documents(spark, sf_dir, "train"), trained(spark, sf_dir).model)
    return V.compare_models(V.long_predictions(rows, "sentiment", MODELS))


@query("compare_all_models")
def compare_all_models(spark, sf_dir):
    """Both lexicon scorers and both trained models on the same test rows."""
    from opinara.registry.evaluation import MODELS as LEXICON_MODELS
    from opinara.registry.evaluation import lexicon_predictions

    test = M.classify_frame(split_documents(spark, sf_dir, "test"), trained(spark, sf_dir).model)
    labels = lexicon_predictions(spark, sf_dir).drop("sentiment")
    rows = test.drop("reviewText").join(labels, "review_id")
    return V.compare_models(V.long_predictions(rows, "sentiment", {**LEXICON_MODELS, **MODELS}))


# What must hold for any solver, next to SQL that says so.
_TEST_ROWS = with_(SQL_RATED, SQL_BASE, SQL_SPLIT)


def _odd_labels(df, *columns):
    """Rows with a label outside the classes, or a final label that breaks the serving rule."""
    known = [F.col(c).isin(*C.CLASSES) for c in columns]
    rule = F.col("final_sentiment").eqNullSafe(F.col("mlp_sentiment"))
    agree = F.col("models_agree").eqNullSafe(F.col("nb_sentiment") == F.col("mlp_sentiment"))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~reduce(lambda a, b: a & b, known)).alias("n_unknown"),
        F.count_if(~rule).alias("n_not_final"),
        F.count_if(~agree).alias("n_not_agree"),
    )


@query(
    "predict_rules",
    _TEST_ROWS
    + "SELECT count(*) AS n_rows, 0::BIGINT AS n_unknown, 0::BIGINT AS n_not_final, 0::BIGINT AS n_not_agree FROM split WHERE split = 'test'",
)
def predict_rules(spark, sf_dir):
    """Every test row gets two known labels, and the final one follows the serving rule."""
    rows = M.classify_frame(split_documents(spark, sf_dir, "test"), trained(spark, sf_dir).model)
    return _odd_labels(rows, "nb_sentiment", "mlp_sentiment", "final_sentiment")


@query(
    "load_model_same",
    _TEST_ROWS + "SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM split WHERE split = 'test'",
)
def load_model_same(spark, sf_dir):
    """The saved and reloaded model labels every test row as the fitted one does."""
    path = scratch_path(spark, "model")
    fitted = trained(spark, sf_dir).model
    fitted.write().overwrite().save(path)
    test = split_documents(spark, sf_dir, "test").select("review_id", "reviewText")
    names = {c: f"{c}_2" for c in M.OUTPUTS}
    again = M.classify_frame(test, PipelineModel.load(path)).drop("reviewText").withColumnsRenamed(names)
    both = M.classify_frame(test, fitted).join(again, "review_id")
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()])
    return both.agg(F.count("*").alias("n_rows"), F.count_if(~same).alias("n_different"))


@query("loss_falls", "SELECT true AS falls, true AS starts_at_zero")
def loss_falls(spark, sf_dir):
    """No iteration of the refitted perceptron ends with a higher loss than the one before."""
    curve = M.loss_curve(trained(spark, sf_dir).perceptron)
    before = F.lag("loss").over(W.partitionBy().orderBy("iteration"))  # at most 201 rows
    rises = curve.withColumn("rise", F.col("loss") - before)
    return rises.agg(
        (F.count_if(F.col("rise") > 1e-9) == 0).alias("falls"), (F.min("iteration") == 0).alias("starts_at_zero")
    )


@query(
    "grid_size",
    "SELECT * FROM (VALUES ('MLP', 3::BIGINT, 1::BIGINT), ('Naive Bayes', 5::BIGINT, 1::BIGINT)) t(model, n_candidates, n_best)",
)
def grid_size(spark, sf_dir):
    """Both grids in full, with one best candidate each."""
    return grid_search_cv(spark, sf_dir).groupBy("model").agg(
        F.count("*").alias("n_candidates"), F.count_if(F.col("is_best")).alias("n_best")
    )


@query(
    "assemble_sizes",
    "SELECT count(*) AS n_rows, 1::BIGINT AS n_sizes, true AS sizes_fit FROM documents",
)
def assemble_sizes(spark, sf_dir):
    """All vectors have the vocabulary's size and three more entries."""
    features = trained(spark, sf_dir).features
    size = len(features.stages[1].vocabulary) + 3
    return assemble(spark, sf_dir).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("n_features").alias("n_sizes"),
        F.bool_and((F.col("n_features") == size) & (F.col("n_stored") <= size)).alias("sizes_fit"),
    )
