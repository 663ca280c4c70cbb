"""Text functions, each over every document and the edge texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.operators import lemma as L
from opinara.operators.dictionary import clean
from opinara.operators.profile import counts_json
from opinara.registry.base import (
    B,
    SQL_REVIEWS_TEXT,
    SQL_SENTIMENT,
    SQL_TEXTS,
    cleaned,
    in_list,
    query,
    sql_clean_expr,
    sql_cleaned,
    sql_stripped,
    sql_exclaims,
    sql_marked,
    sql_tokens,
    sql_upper_count,
    sql_word_count,
    texts,
    with_,
)
from opinara.session import checkpointed
from opinara.sources.reviews import reviews_text

RAW = "coalesce(\"reviewText\", '')"


def _text_query(name, column, expr, sql_expr):
    """Register (review_id, column) = expr over all texts."""
    sql = with_(SQL_TEXTS) + f"SELECT review_id, {sql_expr} AS {column} FROM texts"

    @query(name, sql)
    def run(spark, sf_dir):
        return texts(spark, sf_dir).select(
            "review_id", expr(T.fill_text("reviewText")).alias(column)
        )


_text_query("fill_text", "filled", lambda t: t, RAW)
_text_query("lower", "lowered", F.lower, f"lower({RAW})")
_text_query(
    "regex_strip",
    "stripped",
    lambda t: T.regex_strip(F.lower(t)),
    f"regexp_replace(lower({RAW}), '[^a-zA-Z{B}!]', '', 'g')",
)
_text_query(
    "expand_contractions",
    "expanded",
    T.expand_contractions,
    f"replace({RAW}, 'n''t', ' not')",
)
_text_query(
    "tokenize_ws",
    "tokens",
    lambda t: F.array_join(T.tokens(t), "|"),
    f"coalesce(array_to_string({sql_tokens(RAW)}, '|'), '')",
)
_text_query("char_length", "raw_chars", T.char_length, f"CAST(length({RAW}) AS INTEGER)")
_text_query("word_count", "word_count", T.word_count, sql_word_count(RAW))
_text_query("exclamation_count", "exclamation_count", T.exclamation_count, sql_exclaims(RAW))
_text_query("uppercase_count", "uppercase_count", T.uppercase_count, sql_upper_count(RAW))
_text_query("contains_qmark", "has_question", T.contains_question, f"contains({RAW}, '?')")
_text_query(
    "strip_or_none",
    "stripped",
    T.strip_or_null,
    f"nullif(regexp_replace({RAW}, '^[{B}]+|[{B}]+$', '', 'g'), '')",
)
_text_query("truncate_preview", "preview", T.preview, f"substr({RAW}, 1, 200)")
_text_query(
    "join_tokens",
    "joined",
    lambda t: T.join_tokens(T.tokens(t)),
    f"coalesce(array_to_string({sql_tokens(RAW)}, ' '), '')",
)
_text_query(
    "clean_text_spaced",
    "cleaned_text",
    lambda t: T.clean_text(t, keep_words=(), mode="spaced"),
    sql_clean_expr(RAW, keep=(), mode="spaced"),
)
_text_query(
    "clean_text_letters",
    "cleaned_text",
    lambda t: T.clean_text(t, keep_words=("not", "no"), mode="letters"),
    sql_clean_expr(RAW, keep=("not", "no"), mode="letters"),
)


@query(
    "mark_negation",
    with_(SQL_TEXTS, sql_marked("texts")) + "SELECT review_id, review_neg FROM marked",
)
def mark_negation(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "review_id", T.prepare_training(F.col("reviewText")).alias("review_neg")
    )


@query(
    "mark_negation_serving",
    with_(SQL_TEXTS, sql_marked("texts", negators=C.SERVING_NEGATORS, window=2, expand=False))
    + "SELECT review_id, review_neg FROM marked",
)
def mark_negation_serving(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "review_id", T.prepare_serving(F.col("reviewText")).alias("review_neg")
    )


_FRAME_SQL = (
    with_(
        SQL_TEXTS,
        "pieces AS (SELECT review_id, "
        + sql_tokens("replace(coalesce(\"reviewText\", ''), 'n''t', ' not')")
        + " AS ws FROM texts)",
        "stream AS (SELECT review_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM pieces)",
        f"flagged AS (SELECT *, CAST(lower(w) IN ({in_list(C.NEGATORS)}) AS INTEGER) AS neg FROM stream)",
        "framed AS (SELECT *, coalesce(max(neg) OVER (PARTITION BY review_id ORDER BY pos "
        "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS near FROM flagged)",
    )
    + "SELECT review_id, count(*) FILTER (WHERE neg = 0 AND near = 1) AS n_marked, "
    "sum(neg)::BIGINT AS n_negators FROM framed GROUP BY review_id HAVING sum(neg) > 0"
)


@query("negation_window", _FRAME_SQL)
def negation_window(spark, sf_dir):
    """Marked and negator tokens per review; the reference SQL uses a ROWS frame instead."""
    plain = T.tokens(T.expand_contractions(T.fill_text("reviewText")))
    marked = T.tokens(T.prepare_training(F.col("reviewText")))
    return (
        texts(spark, sf_dir)
        .select("review_id", plain.alias("before"), marked.alias("after"))
        .select(
            "review_id",
            F.size(F.filter(F.arrays_zip("before", "after"), lambda p: p["before"] != p["after"]))
            .cast("bigint")
            .alias("n_marked"),
            F.size(F.filter("before", lambda w: F.lower(w).isin(*C.NEGATORS)))
            .cast("bigint")
            .alias("n_negators"),
        )
        .where("n_negators > 0")
    )


@query(
    "clean_text",
    with_(SQL_TEXTS, sql_cleaned("texts")) + "SELECT review_id, cleaned_text FROM cleaned",
)
def clean_text(spark, sf_dir):
    return cleaned(texts(spark, sf_dir)).select("review_id", "cleaned_text")


_STOP_SQL = (
    f"list_filter({sql_tokens('regexp_replace(lower(' + RAW + '), ' + chr(39) + '[^a-zA-Z' + B + '!]' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, "
    f"lambda w: w NOT IN ({in_list(T.stop_list(C.NEGATORS))}))"
)
_text_query(
    "remove_stopwords",
    "n_kept",
    lambda t: F.size(T.clean_tokens(t)),
    f"CAST(coalesce(len({_STOP_SQL}), 0) AS INTEGER)",
)


@query(
    "numeric_features",
    with_(SQL_TEXTS, sql_cleaned("texts"))
    + "SELECT review_id, CAST(length(cleaned_text) AS INTEGER) AS review_length, "
    + f"{sql_exclaims('review_neg')} AS exclamation_count, {sql_upper_count('review_neg')} AS uppercase_count FROM cleaned",
)
def numeric_features(spark, sf_dir):
    rows = cleaned(texts(spark, sf_dir), counts=True)
    return rows.select("review_id", T.char_length(F.col("cleaned_text")).alias("review_length"), "exclamation_count", "uppercase_count")


@query(
    "ngrams",
    with_(
        SQL_TEXTS,
        sql_cleaned("texts"),
        "uni AS (SELECT review_id, regexp_extract_all(cleaned_text, '\\b\\w\\w+\\b') AS u FROM cleaned)",
        "terms AS (SELECT review_id, list_concat(u, list_transform(u[2:], lambda w, i: concat(u[i], ' ', w))) AS t FROM uni)",
    )
    + "SELECT review_id, CAST(len(t) AS INTEGER) AS n_terms, md5(array_to_string(t, '|')) AS terms_md5 FROM terms",
)
def ngrams(spark, sf_dir):
    return cleaned(texts(spark, sf_dir)).select(
        "review_id", T.terms(F.col("cleaned_text")).alias("t")
    ).select(
        "review_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", "|")).alias("terms_md5")
    )


@query(
    "require_text",
    with_(SQL_TEXTS)
    + f"SELECT review_id, \"reviewText\" FROM texts WHERE regexp_replace({RAW}, '[{B}]', '', 'g') <> ''",
)
def require_text(spark, sf_dir):
    df = texts(spark, sf_dir)
    return df.where(T.strip_or_null(T.fill_text("reviewText")).isNotNull())


@query(
    "rejected_text",
    with_(SQL_TEXTS)
    + f"SELECT review_id FROM texts WHERE regexp_replace({RAW}, '[{B}]', '', 'g') = ''",
)
def rejected_text(spark, sf_dir):
    df = texts(spark, sf_dir)
    return df.where(T.strip_or_null(T.fill_text("reviewText")).isNull()).select("review_id")


_TOKENS_CTE = (
    "toks AS (SELECT review_id, regexp_extract_all(cleaned_text, '[^ ]+') AS ws FROM stripped), "
    "vocab AS (SELECT DISTINCT unnest(ws) AS token FROM toks)"
)
_RULES = ", ".join(f"('{a}', '{b}')" for a, b in C.NOUN_RULES)
_LEMMA_CTE = (
    f"rules(ending, repl) AS (VALUES {_RULES}), "
    "cand AS (SELECT token, concat(left(token, length(token) - length(ending)), repl) AS lemma FROM vocab JOIN rules ON ends_with(token, ending)), "
    "ok AS (SELECT c.token, c.lemma FROM cand c WHERE c.lemma <> '' AND c.lemma IN (SELECT token FROM vocab)), "
    "lemma_map AS (SELECT token, lemma FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY length(lemma), lemma) AS r FROM ok) WHERE r = 1)"
)


def _clean_tokens(spark, sf_dir):
    """(review_id, ws): cleaned, single-spaced text before lemmas."""
    return texts(spark, sf_dir).select("review_id", clean(F.col("reviewText"))["cleaned"].alias("ws"))


@query("lemma_map", with_(SQL_TEXTS, sql_stripped("texts"), _TOKENS_CTE, _LEMMA_CTE) + "SELECT token, lemma FROM lemma_map")
def lemma_map(spark, sf_dir):
    return L.lemma_map(L.vocabulary(_clean_tokens(spark, sf_dir), "ws"))


_LEMMATIZE_SQL = (
    with_(
        SQL_TEXTS,
        sql_stripped("texts"),
        _TOKENS_CTE,
        _LEMMA_CTE,
        "stream AS (SELECT review_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM toks)",
        "looked AS (SELECT review_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS lemmas FROM stream LEFT JOIN lemma_map USING (token) GROUP BY review_id)",
    )
    + "SELECT c.review_id, coalesce(lemmas, '') AS lemmas FROM stripped c LEFT JOIN looked USING (review_id)"
)


@query("lemmatize", _LEMMATIZE_SQL)
def lemmatize(spark, sf_dir):
    toks = checkpointed(_clean_tokens(spark, sf_dir))
    return L.lemma_text(toks, "ws", L.fit_lemmas(toks, "ws")).withColumnRenamed("ws", "lemmas")


@query(
    "lemma_lookup",
    with_(SQL_TEXTS, sql_stripped("texts"), _TOKENS_CTE, _LEMMA_CTE, "stream AS (SELECT unnest(ws) AS token FROM toks)")
    + "SELECT coalesce(lemma, token) AS lemma, count(*) AS n FROM stream LEFT JOIN lemma_map USING (token) GROUP BY 1",
)
def lemma_lookup(spark, sf_dir):
    """Token counts after the lookup: counted before the join, so each token joins once."""
    toks = _clean_tokens(spark, sf_dir)
    split = F.explode(F.array_remove(F.split("ws", " "), ""))
    counts = toks.select(split.alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    lemmas = L.lemma_map(counts.select("token"))
    return (
        counts.join(lemmas, "token", "left")
        .groupBy(F.coalesce("lemma", "token").alias("lemma"))
        .agg(F.sum("n").alias("n"))
    )


@query(
    "label_sentiment",
    with_(SQL_REVIEWS_TEXT)
    + f"SELECT review_id, overall, {SQL_SENTIMENT} AS sentiment FROM (SELECT review_id, overall FROM reviews_text "
    "UNION ALL VALUES (-1, 4.0), (-2, 'NaN'::DOUBLE), (-3, 2.5), (-4, NULL), (-5, 3.0))",
)
def label_sentiment(spark, sf_dir):
    edges = spark.createDataFrame(
        [(-1, 4.0), (-2, float("nan")), (-3, 2.5), (-4, None), (-5, 3.0)],
        "review_id bigint, overall double",
    )
    df = reviews_text(spark, sf_dir).select("review_id", "overall").unionByName(edges)
    return df.withColumn("sentiment", S.label_sentiment(F.col("overall")))


@query(
    "json_dict",
    with_(SQL_REVIEWS_TEXT)
    + "SELECT '{' || string_agg('\"' || sentiment || '\":' || n, ',' ORDER BY sentiment) || '}' AS counts "
    + f"FROM (SELECT {SQL_SENTIMENT} AS sentiment, count(*) AS n FROM reviews_text GROUP BY 1)",
)
def json_dict(spark, sf_dir):
    df = reviews_text(spark, sf_dir).select(S.label_sentiment(F.col("overall")).alias("sentiment"))
    return counts_json(df, "sentiment")
