"""Registration of queries and the SQL fragments their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import text as T
from opinara.operators.dictionary import clean
from opinara.operators.lemma import fit_lemmas, lemma_text
from opinara.session import checkpointed
from opinara.sources.lexicon import OPINION_WORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Texts that exercise rules the supplied prose rarely triggers; appended to the documents.
EDGE_TEXTS = (
    (-1, "I didn't like this card at ALL!!"),
    (-2, "can't WON'T won't"),
    (-3, "not, good"),
    (-4, "no not a b c d"),
    (-5, "NOT 123 GREAT stuff"),
    (-6, "gift-card is 5 stars!"),
    (-7, ""),
    (-8, "   "),
    (-9, "never\tever again my friend"),
    (-10, "Good GOOD good"),
    (-11, "The! the a b"),
    (-12, "It's café não BAD"),
    (-13, None),
    (-14, "Why is this very good card not accepted anywhere? I tried it in ten shops and nobody could say what the problem was."),
    (-15, "I LOVE the really great design but the service was bad and slow"),
    (-16, "never so good Über ALLES!"),
)


def edge_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGE_TEXTS), "review_id bigint, reviewText string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents plus the edge texts: (review_id, reviewText)."""
    from opinara.sources.reviews import documents

    return (
        documents(spark, sf_dir).select("review_id", "reviewText").unionByName(edge_texts(spark))
    )


def _stripped(df: DataFrame) -> DataFrame:
    """The columns but for the text, with `cleaned_text` before lemmas and the two counts."""
    others = [c for c in df.columns if c != "reviewText"]
    made = df.select(*others, clean(F.col("reviewText")).alias("_c"))
    return made.select(*others, F.col("_c.cleaned").alias("cleaned_text"), "_c.exclamation_count", "_c.uppercase_count")


def corpus_lemmas(df: DataFrame) -> DataFrame:
    """The lemma table of the cleaned tokens of these rows."""
    return fit_lemmas(_stripped(df.select("reviewText")), "cleaned_text")


def cleaned(df: DataFrame, lemmas: DataFrame | None = None, counts: bool = False) -> DataFrame:
    """The columns but for the text, with `cleaned_text` and, on request, the two counts.

    Without a given lemma table that of these rows is fitted; texts are then cleaned once into
    a written table, which is read to fit and to apply it.
    """
    d = _stripped(df)
    if not counts:
        d = d.drop("exclamation_count", "uppercase_count")
    if lemmas is None:
        d = checkpointed(d)
        lemmas = fit_lemmas(d, "cleaned_text")
    return lemma_text(d, "cleaned_text", lemmas)


def literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(literal(v) for v in values)


SQL_LEXICON = (
    "lexicon(token, valence, polarity) AS (VALUES "
    + ", ".join(f"({literal(t)}, {v}::DOUBLE, {p}::DOUBLE)" for t, v, p in OPINION_WORDS)
    + ")"
)
SQL_STARS = (
    "CASE WHEN quality=1 AND toxic=0 THEN 5.0 WHEN quality=1 AND toxic=1 THEN 3.0 "
    "WHEN quality=0 AND toxic=0 THEN 2.0 WHEN quality=0 AND toxic=1 THEN 1.0 END::DOUBLE"
)
_DOC = (
    'd.doc_id AS review_id, d.text AS "reviewText", d.source AS asin, '
    "concat('u', d.doc_id % 97) AS \"reviewerID\", d.doc_id * 86400 AS \"unixReviewTime\""
)
SQL_REVIEWS_TEXT = (
    f"reviews_text AS (SELECT {_DOC}, {SQL_STARS} AS overall "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
SQL_RATED = (
    f"rated AS (SELECT {_DOC}, {SQL_STARS} AS overall "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
SQL_RATINGS = (
    "reviews_ratings AS (SELECT md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, "
    "l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))) AS review_id, "
    "CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS overall, "
    'NULL::VARCHAR AS "reviewText", '
    'CAST(o_custkey AS VARCHAR) AS "reviewerID", CAST(l_partkey AS VARCHAR) AS asin, '
    "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 "
    'AS "unixReviewTime" FROM lineitem JOIN orders ON l_orderkey = o_orderkey)'
)
SQL_EDGES = "(VALUES " + ", ".join(f"({i}, {literal(t)})" for i, t in EDGE_TEXTS) + ")"
SQL_TEXTS = (
    'texts AS (SELECT doc_id AS review_id, text AS "reviewText" FROM documents UNION ALL '
    f'SELECT e.i, e.t FROM {SQL_EDGES} e(i, t))'
)
SQL_SENTIMENT = (
    "CASE WHEN overall IS NULL OR isnan(overall) THEN 'Negative' WHEN overall >= 4 THEN 'Positive' "
    "WHEN overall = 3 THEN 'Neutral' ELSE 'Negative' END"
)
B = T.BLANKS


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{B}]+')"


def sql_marked(source: str, carry: str = "", negators=C.NEGATORS, window: int = 3, expand: bool = True) -> str:
    """CTEs words, marked(review_id, carry, review_neg)."""
    raw = "coalesce(\"reviewText\", '')"
    if expand:
        raw = f"replace({raw}, 'n''t', ' not')"
    carry = f", {carry}" if carry else ""
    near = " OR ".join(f"(i > {d} AND neg[i - {d}])" for d in range(1, window + 1))
    return (
        f"words0 AS (SELECT review_id{carry}, {sql_tokens(raw)} AS ws FROM {source}), "
        f"words AS (SELECT *, list_transform(ws, lambda w: lower(w) IN ({in_list(negators)})) AS neg FROM words0), "
        f"marked AS (SELECT review_id{carry}, coalesce(array_to_string(list_transform(ws, lambda w, i: "
        f"CASE WHEN neg[i] THEN w WHEN {near} THEN concat('NOT_', w) ELSE w END), ' '), '') AS review_neg FROM words)"
    )


def sql_clean_expr(x: str, keep=C.NEGATORS, mode: str = "keep_exclaim") -> str:
    pattern, replacement = T.CLEAN_MODES[mode]
    stripped = f"regexp_replace(lower({x}), '{pattern}', '{replacement}', 'g')"
    stops = in_list(T.stop_list(keep))
    return (
        f"coalesce(array_to_string(list_filter({sql_tokens(stripped)}, lambda w: w NOT IN ({stops})), ' '), '')"
    )


def sql_stripped(source: str, carry: str = "", name: str = "stripped") -> str:
    """CTEs up to stripped(review_id, carry, review_neg, cleaned_text): cleaning before lemmas."""
    c = f", {carry}" if carry else ""
    return (
        sql_marked(source, carry)
        + f", {name} AS (SELECT review_id{c}, review_neg, {sql_clean_expr('review_neg')} AS cleaned_text FROM marked)"
    )


def sql_cleaned(source: str, carry: str = "") -> str:
    """CTEs up to cleaned(review_id, carry, review_neg, cleaned_text)."""
    c = f", {carry}" if carry else ""
    rules = ", ".join(f"('{a}', '{b}')" for a, b in C.NOUN_RULES)
    return (
        sql_stripped(source, carry)
        + ", l_toks AS (SELECT review_id, regexp_extract_all(cleaned_text, '[^ ]+') AS ws FROM stripped), "
        "l_vocab AS (SELECT DISTINCT unnest(ws) AS token FROM l_toks), "
        f"l_rules(ending, repl) AS (VALUES {rules}), "
        "l_cand AS (SELECT token, concat(left(token, length(token) - length(ending)), repl) AS lemma FROM l_vocab JOIN l_rules ON ends_with(token, ending)), "
        "l_ok AS (SELECT c.token, c.lemma FROM l_cand c WHERE c.lemma <> '' AND c.lemma IN (SELECT token FROM l_vocab)), "
        "l_map AS (SELECT token, lemma FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY length(lemma), lemma) AS r FROM l_ok) WHERE r = 1), "
        "l_stream AS (SELECT review_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM l_toks), "
        "l_text AS (SELECT review_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS lemmas FROM l_stream LEFT JOIN l_map USING (token) GROUP BY review_id), "
        f"cleaned AS (SELECT s.review_id{c}, review_neg, coalesce(lemmas, '') AS cleaned_text FROM stripped s LEFT JOIN l_text USING (review_id))"
    )


def sql_upper_count(x: str) -> str:
    return (
        f"CAST(len(list_filter({sql_tokens(x)}, lambda w: regexp_matches(w, '\\p{{Lu}}') "
        f"AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]'))) AS INTEGER)"
    )


def sql_exclaims(x: str) -> str:
    return f"CAST(length({x}) - length(replace({x}, '!', '')) AS INTEGER)"


def sql_word_count(x: str) -> str:
    return f"CAST(len({sql_tokens(x)}) AS INTEGER)"


def sql_scores(source: str, text: str, carry: str = "", edges_token: str = "t") -> str:
    """CTE scored(review_id, carry, n_words, n_hits, valence_sum, polarity, compound)."""
    c = f", {carry}" if carry else ""
    carried = "".join(f", any_value({x.strip()}) AS {x.strip()}" for x in carry.split(",") if x.strip())
    return (
        f"stream AS (SELECT review_id{c}, unnest({sql_tokens(text)}) AS w FROM {source}), "
        r"hits AS (SELECT s.*, valence, polarity FROM (SELECT *, lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS token FROM stream) s LEFT JOIN lexicon USING (token)), "
        "per_review AS (SELECT review_id, CAST(count(w) AS INTEGER) AS n_words, CAST(count(valence) AS INTEGER) AS n_hits, "
        "coalesce(sum(valence), 0.0) AS valence_sum, coalesce(avg(polarity), 0.0) AS polarity FROM hits GROUP BY review_id), "
        f"scored AS (SELECT b.review_id{c}, coalesce(n_words, 0) AS n_words, coalesce(n_hits, 0) AS n_hits, "
        "coalesce(valence_sum, 0.0) AS valence_sum, coalesce(polarity, 0.0) AS polarity, "
        f"coalesce(valence_sum / sqrt(valence_sum * valence_sum + {C.COMPOUND_ALPHA}), 0.0) AS compound "
        f"FROM {source} b LEFT JOIN per_review p ON b.review_id = p.review_id)"
    )


def sql_label(score: str, threshold: float, inclusive: bool = False) -> str:
    eq = "=" if inclusive else ""
    return (
        f"CASE WHEN {score} >{eq} {threshold} THEN 'Positive' WHEN {score} <{eq} -{threshold} "
        "THEN 'Negative' ELSE 'Neutral' END"
    )


def sql_key(id_col: str = "review_id", seed: int = 42) -> str:
    return f"md5(concat_ws('|', CAST({id_col} AS VARCHAR), '{seed}'))"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
