"""TF-IDF, scaling, label encoding and relational naive Bayes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.operators import bayes as NB
from opinara.operators import features as X
from opinara.registry.base import (
    SQL_RATED,
    SQL_RATINGS,
    SQL_SENTIMENT,
    SQL_TEXTS,
    cleaned,
    in_list,
    query,
    sql_clean_expr,
    sql_cleaned,
    sql_exclaims,
    sql_marked,
    sql_tokens,
    sql_upper_count,
    texts,
    with_,
)
from opinara.registry.sampling import SQL_BASE, SQL_SPLIT, split_rows
from opinara.session import checkpointed
from opinara.sources.reviews import documents, reviews_ratings

RAW = "coalesce(\"reviewText\", '')"


def sql_doc_terms(source: str = "cleaned", carry: str = "") -> str:
    c = f", {carry}" if carry else ""
    return (
        f"uni AS (SELECT review_id{c}, regexp_extract_all(cleaned_text, '\\b\\w\\w+\\b') AS u FROM {source}), "
        f"exploded AS (SELECT review_id{c}, unnest(list_concat(u, list_transform(u[2:], lambda w, i: concat(u[i], ' ', w)))) AS term FROM uni), "
        f"doc_terms AS (SELECT review_id{c}, term, count(*) AS tf FROM exploded GROUP BY ALL)"
    )


def sql_vocabulary(docs: str, doc_terms: str = "doc_terms") -> str:
    return (
        f"stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM {doc_terms} GROUP BY term), "
        f"nd AS (SELECT count(*) AS n_docs FROM {docs}), "
        "vocabulary AS (SELECT term, tf, df, n_docs, ln((1 + n_docs) / (1 + df)::DOUBLE) + 1.0 AS idf FROM stats, nd "
        "WHERE df >= 2 AND df <= 0.85::DOUBLE * n_docs ORDER BY tf DESC, term LIMIT 8000)"
    )


def sql_weights(carry: str = "") -> str:
    c = f", {carry}" if carry else ""
    return (
        f"raw AS (SELECT review_id{c}, term, (1.0 + ln(tf)) * idf AS raw FROM doc_terms JOIN (SELECT term, idf FROM vocabulary) USING (term)), "
        f"weights AS (SELECT review_id{c}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY review_id)) AS weight FROM raw)"
    )


SQL_CORPUS = (SQL_TEXTS, sql_cleaned("texts"), sql_doc_terms())
SQL_FITTED = (*SQL_CORPUS, sql_vocabulary("cleaned"))


def _corpus(spark, sf_dir):
    return cleaned(texts(spark, sf_dir).select("review_id", "reviewText"))


def _fitted(spark, sf_dir):
    """Cleaned texts and vocabulary; fitting and applying read the texts, written once."""
    docs = checkpointed(_corpus(spark, sf_dir))
    return docs, X.fit_vocabulary(X.vocab_stats(docs), docs)


@query(
    "vocab_stats",
    with_(*SQL_CORPUS) + "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM doc_terms GROUP BY term",
)
def vocab_stats(spark, sf_dir):
    return X.vocab_stats(_corpus(spark, sf_dir))


@query("vocab_topk", with_(*SQL_FITTED) + "SELECT term, tf, df FROM vocabulary ORDER BY tf DESC, term LIMIT 5000")
def vocab_topk(spark, sf_dir):
    from opinara.config import TfidfConfig

    stats = X.vocab_stats(_corpus(spark, sf_dir))
    fitted = X.fit_vocabulary(stats, texts(spark, sf_dir).select("review_id"), TfidfConfig(max_features=5000))
    return fitted.select("term", "tf", "df")


@query(
    "tfidf_fit",
    with_(*SQL_FITTED) + "SELECT term, tf, df, round(idf, 6) AS idf FROM vocabulary",
)
def tfidf_fit(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].select("term", "tf", "df", F.round("idf", 6).alias("idf"))


@query(
    "idf_join",
    with_(*SQL_FITTED)
    + "SELECT review_id, count(*) AS n_known, round(sum(tf * idf), 4) AS idf_mass FROM (SELECT d.review_id, d.tf, v.idf FROM doc_terms d JOIN vocabulary v ON d.term = v.term) GROUP BY review_id",
)
def idf_join(spark, sf_dir):
    docs, vocabulary = _fitted(spark, sf_dir)
    return X.known_terms(docs, vocabulary).withColumn("idf_mass", F.round("idf_mass", 4))


@query(
    "tfidf_weights",
    with_(*SQL_FITTED, sql_weights()) + "SELECT review_id, term, round(weight, 6) AS weight FROM weights",
)
def tfidf_weights(spark, sf_dir):
    return X.tfidf_weights(*_fitted(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    "mean_tfidf",
    with_(*SQL_FITTED, sql_weights())
    + "SELECT term, round(sum(weight) / any_value(n_docs), 8) AS mean_weight FROM weights, nd GROUP BY term",
)
def mean_tfidf(spark, sf_dir):
    means = X.mean_weights(*_fitted(spark, sf_dir))
    return means.withColumn("mean_weight", F.round("mean_weight", 8))


@query(
    "top_terms",
    with_(*SQL_FITTED, sql_weights())
    + "SELECT term, round(sum(weight) / any_value(n_docs), 9) AS mean_weight FROM weights, nd GROUP BY term ORDER BY mean_weight DESC, term LIMIT 20",
)
def top_terms(spark, sf_dir):
    means = X.mean_weights(*_fitted(spark, sf_dir))
    return X.top_terms(means).withColumn("mean_weight", F.round("mean_weight", 9))


@query(
    "matrix_shape",
    with_(*SQL_FITTED)
    + "SELECT (SELECT n_docs FROM nd) AS n_docs, (SELECT count(*) FROM vocabulary) AS n_terms, count(*) AS nnz FROM doc_terms JOIN vocabulary USING (term)",
)
def matrix_shape(spark, sf_dir):
    return X.matrix_shape(*_fitted(spark, sf_dir))


@query(
    "stopword_anti",
    with_(
        SQL_TEXTS,
        f"stream AS (SELECT unnest({sql_tokens('lower(' + RAW + ')')}) AS token FROM texts)",
    )
    + f"SELECT token, count(*) AS n FROM stream WHERE token NOT IN ({in_list(T.stop_list(C.NEGATORS))}) GROUP BY token",
)
def stopword_anti(spark, sf_dir):
    """Anti-join form of stop-word removal; the constant list bounds the broadcast."""
    stops = spark.createDataFrame([(w,) for w in T.stop_list(C.NEGATORS)], "token string")
    stream = texts(spark, sf_dir).select(
        F.explode(T.tokens(F.lower(T.fill_text("reviewText")))).alias("token")
    )
    return (
        stream.join(F.broadcast(stops), "token", "left_anti")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


SQL_NUMERIC = (
    "numeric_rows AS (SELECT c.review_id, length(cleaned_text)::DOUBLE AS review_length, "
    f"{sql_exclaims('review_neg')}::DOUBLE AS exclamation_count, {sql_upper_count('review_neg')}::DOUBLE AS uppercase_count FROM cleaned c)"
)
_FEATURES = X.NUMERIC_FEATURES
SQL_LIMITS = (
    "limits AS (SELECT "
    + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _FEATURES)
    + " FROM numeric_rows JOIN split USING (review_id) WHERE split = 'train')"
)
SQL_SCALED = (
    "scaled AS (SELECT review_id, "
    + ", ".join(
        f"({c} - {c}_lo) / CASE WHEN {c}_hi = {c}_lo THEN 1.0 ELSE {c}_hi - {c}_lo END AS {c}" for c in _FEATURES
    )
    + " FROM numeric_rows, limits)"
)
SQL_TRAINED = (SQL_RATED, SQL_BASE, SQL_SPLIT, sql_cleaned("rated"), SQL_NUMERIC, SQL_LIMITS, SQL_SCALED)


def prepared_split(spark, sf_dir):
    """Rated reviews with text columns, numeric features, label and split tag.

    Written once: vocabulary, scaling limits, weights and scores all read it.
    """
    split = split_rows(spark, sf_dir).select("review_id", "overall", "sentiment", "split")
    docs = documents(spark, sf_dir).select("review_id", "reviewText").join(split, "review_id")
    rows = cleaned(docs, counts=True)
    return checkpointed(rows.withColumn("review_length", T.char_length(F.col("cleaned_text"))))


@query(
    "minmax_fit",
    with_(SQL_RATED, SQL_BASE, SQL_SPLIT, sql_cleaned("rated"), SQL_NUMERIC, SQL_LIMITS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}_lo AS lo, {c}_hi AS hi FROM limits" for c in _FEATURES
    ),
)
def minmax_fit(spark, sf_dir):
    return X.minmax_fit(prepared_split(spark, sf_dir).where("split = 'train'"))


@query(
    "minmax_scale",
    with_(*SQL_TRAINED)
    + "SELECT review_id, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURES)
    + " FROM scaled",
)
def minmax_scale(spark, sf_dir):
    rows = prepared_split(spark, sf_dir)
    scaled = X.minmax_scale(rows, rows.where("split = 'train'"))
    return scaled.select("review_id", *[F.round(c, 6).alias(c) for c in _FEATURES])


@query(
    "label_encode",
    with_(SQL_RATINGS)
    + f"SELECT review_id, sentiment, CASE sentiment WHEN 'Negative' THEN 0.0 WHEN 'Neutral' THEN 1.0 ELSE 2.0 END::DOUBLE AS label_index FROM (SELECT review_id, {SQL_SENTIMENT} AS sentiment FROM reviews_ratings)",
)
def label_encode(spark, sf_dir):
    labelled = reviews_ratings(spark, sf_dir).select(
        "review_id", S.label_sentiment(F.col("overall")).alias("sentiment")
    )
    index = S.class_index(F.col("sentiment"))
    return labelled.select("review_id", S.class_name(index).alias("sentiment"), index.alias("label_index"))


def train_features(spark, sf_dir):
    """Training and test rows as sparse features of the training vocabulary and limits."""
    rows = prepared_split(spark, sf_dir)
    train = rows.where("split = 'train'")
    vocabulary = X.fit_vocabulary(X.vocab_stats(train), train)
    return X.sparse_features(rows, train, vocabulary, keep=["sentiment", "split"])


def bayes_predictions(spark, sf_dir, alpha: float = 1.0, part: str = "test"):
    """Naive Bayes fitted on the training rows, scores of the rows of a part."""
    rows, size = train_features(spark, sf_dir)
    model = NB.fit_bayes(rows.where("split = 'train'"), size, alpha)
    return NB.score_bayes(rows.where(F.col("split") == part), model)


SQL_BAYES = (
    *SQL_TRAINED,
    "tagged AS (SELECT c.review_id, cleaned_text, sentiment, split FROM cleaned c JOIN split USING (review_id))",
    sql_doc_terms("tagged", "sentiment, split"),
    "train_terms AS (SELECT * FROM doc_terms WHERE split = 'train')",
    "train_docs AS (SELECT * FROM tagged WHERE split = 'train')",
    sql_vocabulary("train_docs", "train_terms"),
    sql_weights("sentiment, split"),
    "numerics AS (UNPIVOT scaled ON review_length, exclamation_count, uppercase_count INTO NAME feature VALUE weight)",
    "x AS (SELECT review_id, sentiment, split, term, weight FROM weights UNION ALL "
    "SELECT n.review_id, t.sentiment, t.split, '<' || feature || '>', weight FROM numerics n JOIN tagged t USING (review_id))",
    "mass AS (SELECT term, "
    + ", ".join(f"sum(CASE WHEN sentiment = '{c}' THEN weight ELSE 0.0 END) AS m_{c}" for c in C.CLASSES)
    + " FROM x WHERE split = 'train' GROUP BY term)",
    "tot AS (SELECT " + ", ".join(f"sum(m_{c}) AS t_{c}" for c in C.CLASSES) + ", count(*) AS d_seen FROM mass)",
    "dims AS (SELECT count(*) + 3 AS d FROM vocabulary)",
    "theta AS (SELECT term, "
    + ", ".join(f"ln((m_{c} + 1.0) / (t_{c} + 1.0 * d)) AS th_{c}" for c in C.CLASSES)
    + " FROM mass, tot, dims)",
    "prior AS (SELECT "
    + ", ".join(f"ln(count(*) FILTER (WHERE sentiment = '{c}') / count(*)::DOUBLE) AS p_{c}" for c in C.CLASSES)
    + " FROM train_docs)",
    "nb_scores AS (SELECT review_id, "
    + ", ".join(f"any_value(p_{c}) + sum(weight * th_{c}) AS score_{c}" for c in C.CLASSES)
    + " FROM x JOIN theta USING (term), prior WHERE split = 'test' GROUP BY review_id)",
    "nb AS (SELECT *, CASE WHEN score_Negative >= score_Neutral AND score_Negative >= score_Positive THEN 'Negative' "
    "WHEN score_Neutral >= score_Positive THEN 'Neutral' ELSE 'Positive' END AS nb_sentiment FROM nb_scores)",
)


@query(
    "nb_relational",
    with_(*SQL_BAYES)
    + "SELECT review_id, nb_sentiment, "
    + ", ".join(f"round(score_{c}, 5) AS score_{c}" for c in C.CLASSES)
    + " FROM nb",
)
def nb_relational(spark, sf_dir):
    return bayes_predictions(spark, sf_dir).select(
        "review_id", "nb_sentiment", *[F.round(f"score_{c}", 5).alias(f"score_{c}") for c in C.CLASSES]
    )


@query(
    "assemble_rows",
    with_(*SQL_BAYES)
    + "SELECT review_id, any_value(split) AS split, (SELECT d FROM dims) AS n_features, count(*) FILTER (WHERE weight <> 0) AS n_stored, "
    "round(sum(weight), 5) AS weight_sum, round(sum(weight * weight), 5) AS square_sum FROM x GROUP BY review_id",
)
def assemble_rows(spark, sf_dir):
    """Terms and scaled counts of every rated row side by side: sizes and sums of its features."""
    rows, size = train_features(spark, sf_dir)
    weights = F.col("features")["weights"]
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return rows.select(
        "review_id",
        "split",
        F.lit(size).cast("long").alias("n_features"),
        F.size(F.filter(weights, lambda w: w != 0)).cast("long").alias("n_stored"),
        F.round(total(weights), 5).alias("weight_sum"),
        F.round(total(F.transform(weights, lambda w: w * w)), 5).alias("square_sum"),
    )
