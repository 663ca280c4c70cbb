"""Review selection, prompts and generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.operators import generate as G
from opinara.registry.base import SQL_TEXTS, literal, query, sql_key, sql_tokens, sql_word_count, texts, with_

RAW = "coalesce(\"reviewText\", '')"
ORDER = f"{sql_key()}, CAST(review_id AS VARCHAR)"
SQL_LONG = f"long AS (SELECT review_id, {RAW} AS \"reviewText\", {sql_word_count(RAW)} AS word_count FROM texts WHERE {sql_word_count(RAW)} > 100)"
SQL_PICKED = (
    SQL_LONG,
    f"picked AS (SELECT *, CAST(row_number() OVER (ORDER BY {ORDER}) - 1 AS INTEGER) AS review_index FROM (SELECT * FROM long ORDER BY {ORDER} LIMIT 10))",
)
SQL_QUESTION = (
    f"question AS (SELECT review_id, {RAW} AS \"reviewText\", {sql_word_count(RAW)} AS word_count FROM texts "
    f"WHERE contains({RAW}, '?') AND {sql_word_count(RAW)} >= 20 ORDER BY review_id LIMIT 1)"
)


@query(
    "select_summary_reviews",
    with_(SQL_TEXTS, *SQL_PICKED) + 'SELECT review_index, review_id, word_count, "reviewText" FROM picked',
)
def select_summary_reviews(spark, sf_dir):
    return G.summary_reviews(texts(spark, sf_dir)).select(
        "review_index", "review_id", "word_count", "reviewText"
    )


def _question(spark, sf_dir):
    return G.first_row(G.question_reviews(texts(spark, sf_dir)))


@query(
    "select_question_review",
    with_(SQL_TEXTS, SQL_QUESTION) + 'SELECT review_id, word_count, "reviewText" FROM question',
)
def select_question_review(spark, sf_dir):
    return _question(spark, sf_dir).select("review_id", "word_count", "reviewText")


def _messages(df, *keys):
    return df.select(*keys, F.posexplode("messages").alias("turn", "m")).select(
        *keys, "turn", "m.role", "m.content"
    )


_SUMMARY_SQL = f"SELECT review_index, 0 AS turn, 'user' AS role, concat({literal(C.SUMMARY_INSTRUCTION)}, \"reviewText\") AS content FROM picked"


@query("summary_prompts", with_(SQL_TEXTS, *SQL_PICKED) + _SUMMARY_SQL)
def summary_prompts(spark, sf_dir):
    return _messages(G.with_summary_prompt(G.summary_reviews(texts(spark, sf_dir))), "review_index")


_SERVICE_SQL = (
    f"SELECT review_id, 0 AS turn, 'system' AS role, {literal(C.SERVICE_INSTRUCTION)} AS content FROM question "
    f"UNION ALL SELECT review_id, 1, 'user', concat('{C.SERVICE_PREFIX}', \"reviewText\") FROM question"
)


@query("service_prompts", with_(SQL_TEXTS, SQL_QUESTION) + _SERVICE_SQL)
def service_prompts(spark, sf_dir):
    return _messages(G.with_service_prompt(_question(spark, sf_dir)), "review_id")


@query(
    "prompt_build",
    with_(SQL_TEXTS)
    + f"SELECT review_id, 'user' AS role, concat({literal(C.SUMMARY_INSTRUCTION)}, {RAW}) AS content FROM texts",
)
def prompt_build(spark, sf_dir):
    """A prompt for every text: a projection, whatever the number of rows."""
    messages = S.summary_prompt(T.fill_text("reviewText"))
    return texts(spark, sf_dir).select("review_id", F.inline(messages))
