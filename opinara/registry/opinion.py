"""Lexicon scores and rating enhancement."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.operators import enhance as E
from opinara.operators import lexicon as L
from opinara.operators.profile import count_long, histogram, rating_pair_bins
from opinara.registry.base import (
    SQL_LEXICON,
    SQL_RATED,
    SQL_TEXTS,
    cleaned,
    in_list,
    query,
    sql_cleaned,
    sql_exclaims,
    sql_label,
    sql_marked,
    sql_scores,
    sql_tokens,
    texts,
    with_,
)
from opinara.registry.profile import STATS, _round, _sql_describe, _sql_histogram
from opinara.sources.lexicon import built_in_lexicon
from opinara.sources.reviews import rated_reviews

RAW = "coalesce(\"reviewText\", '')"
EDGE_SQL = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$'"


def _token_sql(w: str) -> str:
    return f"lower(regexp_replace({w}, {EDGE_SQL}, '', 'g'))"


@query(
    "lexicon_lookup",
    with_(
        SQL_TEXTS,
        SQL_LEXICON,
        f"stream AS (SELECT review_id, unnest({sql_tokens(RAW)}) AS w FROM texts)",
    )
    + f"SELECT l.token, valence, polarity, count(*) AS n, count(DISTINCT review_id) AS n_reviews FROM stream JOIN lexicon l ON {_token_sql('w')} = l.token GROUP BY ALL",
)
def lexicon_lookup(spark, sf_dir):
    """Occurrences per lexicon word; counted per review first, so hot words collapse early."""
    hits = L.lexicon_hits(texts(spark, sf_dir), built_in_lexicon(spark), "reviewText", bounded=True)
    per_review = hits.groupBy("review_id", "token", "valence", "polarity").agg(
        F.count(F.lit(1)).alias("c")
    )
    return per_review.groupBy("token", "valence", "polarity").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_reviews")
    )


def _scored_texts(spark, sf_dir):
    return L.lexicon_scores(texts(spark, sf_dir), built_in_lexicon(spark), "reviewText", bounded=True)


SQL_SCORED_TEXTS = with_(SQL_TEXTS, SQL_LEXICON, sql_scores("texts", RAW))


@query(
    "lexicon_compound",
    SQL_SCORED_TEXTS + "SELECT review_id, n_hits, round(compound, 6) AS compound FROM scored",
)
def lexicon_compound(spark, sf_dir):
    return _scored_texts(spark, sf_dir).select(
        "review_id", "n_hits", F.round("compound", 6).alias("compound")
    )


@query(
    "lexicon_polarity",
    SQL_SCORED_TEXTS + "SELECT review_id, n_words, round(polarity, 6) AS polarity FROM scored",
)
def lexicon_polarity(spark, sf_dir):
    return _scored_texts(spark, sf_dir).select(
        "review_id", "n_words", F.round("polarity", 6).alias("polarity")
    )


def _up(w: str) -> str:
    return f"(regexp_matches({w}, '\\p{{Lu}}') AND NOT regexp_matches({w}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def _step(i: int) -> str:
    w, prev, decay = f"w{i}", f"v{i - 1}", C.BOOST_DECAY[i - 1]
    caps = f"CASE WHEN mixed AND {_up(w)} THEN {C.CAPS_BOOST} ELSE 0.0 END"
    strength = (
        f"CASE WHEN {_token_sql(w)} IN ({in_list(C.BOOSTERS_UP)}) THEN {C.BOOST} + {caps} "
        f"WHEN {_token_sql(w)} IN ({in_list(C.BOOSTERS_DOWN)}) THEN -{C.BOOST} + {caps} ELSE 0.0 END"
    )
    return (
        f"s{i} AS (SELECT *, ({prev} + coalesce({strength}, 0.0)::DOUBLE * CASE WHEN {prev} > 0 THEN 1.0 ELSE -1.0 END * {decay}) "
        f"* CASE WHEN coalesce({_token_sql(w)} IN ({in_list(C.RULE_NEGATORS)}), false) THEN {C.NEGATION_FACTOR} ELSE 1.0 END AS v{i} FROM s{i - 1})"
    )


_RULES_SQL = (
    with_(
        SQL_TEXTS,
        SQL_LEXICON,
        f"p AS (SELECT review_id, {sql_tokens(RAW)} AS ws, least({sql_exclaims(RAW)}, {C.EXCLAIM_MAX}) AS exclaims FROM texts)",
        "stream AS (SELECT review_id, exclaims, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM p)",
        f"ctx AS (SELECT *, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2, lag(w, 3) OVER o AS w3, "
        f"count(*) FILTER (WHERE {_up('w')}) OVER r AS n_up, count(*) OVER r AS n_words, "
        "min(CASE WHEN lower(w) = 'but' THEN pos END) OVER r AS but_at FROM stream "
        "WINDOW o AS (PARTITION BY review_id ORDER BY pos), r AS (PARTITION BY review_id))",
        f"s0 AS (SELECT c.*, (n_up > 0 AND n_up < n_words) AS mixed, valence, valence + CASE WHEN (n_up > 0 AND n_up < n_words) AND {_up('w')} "
        f"THEN CASE WHEN valence > 0 THEN {C.CAPS_BOOST} ELSE -{C.CAPS_BOOST} END ELSE 0.0 END AS v0 FROM ctx c JOIN lexicon l ON {_token_sql('c.w')} = l.token)",
        _step(1),
        _step(2),
        _step(3),
        f"sums AS (SELECT review_id, count(*) AS n_hits, any_value(exclaims) AS exclaims, sum(v3 * CASE WHEN pos < but_at THEN {C.BUT_BEFORE} WHEN pos > but_at THEN {C.BUT_AFTER} ELSE 1.0 END) AS total FROM s3 GROUP BY review_id)",
        f"amp AS (SELECT review_id, n_hits, CASE WHEN total > 0 THEN total + exclaims * {C.EXCLAIM_STEP} WHEN total < 0 THEN total - exclaims * {C.EXCLAIM_STEP} ELSE 0.0 END AS a FROM sums)",
    )
    + f"SELECT t.review_id, CAST(coalesce(n_hits, 0) AS INTEGER) AS n_hits, round(coalesce(a / sqrt(a * a + {C.COMPOUND_ALPHA}), 0.0), 6) AS compound FROM texts t LEFT JOIN amp USING (review_id)"
)


@query("lexicon_compound_rules", _RULES_SQL)
def lexicon_compound_rules(spark, sf_dir):
    scored = L.rule_scores(texts(spark, sf_dir), built_in_lexicon(spark), "reviewText", bounded=True)
    return scored.select("review_id", "n_hits", F.round("compound", 6).alias("compound"))


SQL_SCORED_CLEAN = with_(
    SQL_TEXTS, SQL_LEXICON, sql_cleaned("texts"), sql_scores("cleaned", "cleaned_text")
)


def _scored_clean(spark, sf_dir):
    return L.lexicon_scores(
        cleaned(texts(spark, sf_dir)), built_in_lexicon(spark), "cleaned_text", bounded=True
    )


@query(
    "lexicon_predict",
    SQL_SCORED_CLEAN
    + f"SELECT review_id, {sql_label('compound', C.COMPOUND_THRESHOLD)} AS vader, {sql_label('polarity', 0)} AS textblob FROM scored",
)
def lexicon_predict(spark, sf_dir):
    return L.predict_from_scores(_scored_clean(spark, sf_dir)).select("review_id", "vader", "textblob")


@query(
    "threshold_label",
    SQL_SCORED_TEXTS
    + f"SELECT review_id, {sql_label('compound', C.COMPOUND_THRESHOLD)} AS strict, {sql_label('compound', C.COMPOUND_THRESHOLD, True)} AS inclusive FROM "
    "(SELECT review_id, compound FROM scored UNION ALL VALUES (-101, 0.05::DOUBLE), (-102, -0.05::DOUBLE), (-103, 0.0::DOUBLE))",
)
def threshold_label(spark, sf_dir):
    edges = spark.createDataFrame(
        [(-101, 0.05), (-102, -0.05), (-103, 0.0)], "review_id bigint, compound double"
    )
    df = _scored_texts(spark, sf_dir).select("review_id", "compound").unionByName(edges)
    score = F.col("compound")
    return df.select(
        "review_id",
        S.threshold_label(score, C.COMPOUND_THRESHOLD).alias("strict"),
        S.threshold_label(score, C.COMPOUND_THRESHOLD, inclusive=True).alias("inclusive"),
    )


def enhanced_reviews(spark, sf_dir):
    """Scores of the negation-marked text, blended with the stars; text is not carried."""
    marked = rated_reviews(spark, sf_dir).select(
        "review_id", "overall", T.prepare_training(F.col("reviewText")).alias("review_neg")
    )
    scored = L.lexicon_scores(
        marked, built_in_lexicon(spark), "review_neg", keep=["overall"], bounded=True
    )
    return E.enhance_confidence(scored)


SQL_ENHANCED = with_(
    SQL_RATED,
    SQL_LEXICON,
    sql_marked("rated", "overall"),
    sql_scores("marked", "review_neg", "overall"),
    "b AS (SELECT *, greatest(-1.0, least(0.6 * compound + 0.4 * polarity, 1.0)) AS s FROM scored)",
    "c AS (SELECT *, ((s + 1) / 2) * 4 + 1 AS r, greatest(0.0, least(0.5 * abs(s) + 0.3 * (1.0 - least(abs(compound - polarity) / 2.0, 1.0)) + 0.2 * least(n_words / 100.0::DOUBLE, 1.0), 1.0)) AS conf FROM b)",
    "d AS (SELECT *, (1.0 - 0.7::DOUBLE) * conf AS tw FROM c)",
    "enhanced AS (SELECT review_id, overall, n_words, compound, round(compound, 4) AS vader_compound, round(polarity, 4) AS textblob_polarity, "
    "round(s, 4) AS text_sentiment_score, round(r, 4) AS text_based_rating, round(conf, 4) AS text_confidence, "
    "round(tw, 4) AS effective_text_weight, round(1.0 - tw, 4) AS effective_rating_weight, "
    "round((1.0 - tw) * overall + tw * r, 4) AS enhanced_rating FROM d)",
    "enhanced_diff AS (SELECT *, abs(enhanced_rating - overall) AS rating_diff FROM enhanced)",
)
COLS = ", ".join(E.ENHANCED_COLUMNS)


@query(
    "enhance_confidence",
    SQL_ENHANCED + f"SELECT review_id, overall, {COLS}, round(rating_diff, 6) AS rating_diff FROM enhanced_diff",
)
def enhance_confidence(spark, sf_dir):
    return enhanced_reviews(spark, sf_dir).select(
        "review_id", "overall", *E.ENHANCED_COLUMNS, F.round("rating_diff", 6).alias("rating_diff")
    )


# Reviews whose stars and words contradict each other, and some that agree.
ALPHA_EDGES = (
    (-201, 5.0, "stupid trash worthless pathetic disgusting loser moron scum idiot bad"),
    (-202, 1.0, "great good love great good love great good love like"),
    (-203, 5.0, "great good love"),
    (-204, 1.0, "bad trash"),
    (-205, 5.0, "bad"),
    (-206, None, "bad"),
)
_ALPHA_VALUES = ", ".join(f"({i}, {'NULL' if o is None else o}::DOUBLE, '{t}')" for i, o, t in ALPHA_EDGES)
SQL_ALPHA = (
    with_(
        SQL_RATED,
        f'joined AS (SELECT review_id, overall, "reviewText" FROM rated UNION ALL VALUES {_ALPHA_VALUES})',
        SQL_LEXICON,
        sql_marked("joined", "overall"),
        sql_scores("marked", "review_neg", "overall"),
        "enhanced AS (SELECT review_id, overall, compound FROM scored)",
    ).rstrip()
    + ", alpha AS (SELECT review_id, overall, round((0.6 * (overall - 1) / 4 + (1 - 0.6) * (compound + 1) / 2) * 4 + 1, 4) AS enhanced_rating FROM enhanced), "
    "alpha_diff AS (SELECT *, abs(enhanced_rating - overall) AS rating_diff FROM alpha) "
)


def alpha_reviews(spark, sf_dir):
    edges = spark.createDataFrame(list(ALPHA_EDGES), "review_id bigint, overall double, reviewText string")
    rated = rated_reviews(spark, sf_dir).select("review_id", "overall", "reviewText").unionByName(edges)
    marked = rated.select("review_id", "overall", T.prepare_training(F.col("reviewText")).alias("review_neg"))
    scored = L.lexicon_scores(
        marked, built_in_lexicon(spark), "review_neg", keep=["overall"], bounded=True
    )
    return E.enhance_alpha(scored)


@query(
    "enhance_alpha",
    SQL_ALPHA + "SELECT review_id, overall, enhanced_rating, round(rating_diff, 6) AS rating_diff FROM alpha_diff",
)
def enhance_alpha(spark, sf_dir):
    return alpha_reviews(spark, sf_dir).select(
        "review_id", "overall", "enhanced_rating", F.round("rating_diff", 6).alias("rating_diff")
    )


@query(
    "high_disagreement",
    SQL_ALPHA
    + "SELECT review_id, overall, enhanced_rating, round(rating_diff, 6) AS rating_diff FROM alpha_diff WHERE rating_diff > 1.5",
)
def high_disagreement(spark, sf_dir):
    """Stars against the text; the appended reviews lie on both sides of the threshold."""
    return E.high_disagreement(alpha_reviews(spark, sf_dir)).select(
        "review_id", "overall", "enhanced_rating", F.round("rating_diff", 6).alias("rating_diff")
    )


@query(
    "top_disagreement",
    SQL_ALPHA
    + "SELECT review_id, overall, enhanced_rating, round(rating_diff, 6) AS rating_diff FROM alpha_diff ORDER BY rating_diff DESC, review_id LIMIT 5",
)
def top_disagreement(spark, sf_dir):
    return (
        alpha_reviews(spark, sf_dir)
        .withColumn("rating_diff", F.round("rating_diff", 6))
        .orderBy(F.desc("rating_diff"), "review_id")
        .limit(5)
        .select("review_id", "overall", "enhanced_rating", "rating_diff")
    )


@query(
    "count_disagreement",
    SQL_ALPHA + "SELECT count(*) FILTER (WHERE rating_diff > 1.5) AS n FROM alpha_diff",
)
def count_disagreement(spark, sf_dir):
    return count_long(alpha_reviews(spark, sf_dir), F.col("rating_diff") > 1.5)


@query(
    "abs_diff",
    SQL_ENHANCED + "SELECT review_id, round(abs(enhanced_rating - overall), 6) AS rating_diff FROM enhanced",
)
def abs_diff(spark, sf_dir):
    return enhanced_reviews(spark, sf_dir).select(
        "review_id", F.round("rating_diff", 6).alias("rating_diff")
    )


@query(
    "enhancement_summary",
    SQL_ENHANCED
    + "SELECT round(avg(overall), 6) AS mean_original_rating, round(avg(enhanced_rating), 6) AS mean_enhanced_rating, round(avg(rating_diff), 6) AS mean_rating_diff, round(max(rating_diff), 6) AS max_rating_diff, round(avg(text_confidence), 6) AS mean_text_confidence FROM enhanced_diff",
)
def enhancement_summary(spark, sf_dir):
    out = E.enhancement_summary(enhanced_reviews(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "enhanced_vs_original",
    SQL_ENHANCED + _sql_describe("enhanced", "overall") + " UNION ALL " + _sql_describe("enhanced", "enhanced_rating"),
)
def enhanced_vs_original(spark, sf_dir):
    return _round(E.enhanced_vs_original(enhanced_reviews(spark, sf_dir)), STATS)


@query(
    "histogram_enhanced",
    SQL_ENHANCED.rstrip() + ", " + _sql_histogram("enhanced", "enhanced_rating", 30),
)
def histogram_enhanced(spark, sf_dir):
    out = histogram(enhanced_reviews(spark, sf_dir), "enhanced_rating", 30)
    return _round(out, ["left_edge", "right_edge"])


@query(
    "rating_pairs",
    SQL_ENHANCED + "SELECT review_id, overall, enhanced_rating FROM enhanced",
)
def rating_pairs(spark, sf_dir):
    return enhanced_reviews(spark, sf_dir).select("review_id", "overall", "enhanced_rating")


@query(
    "rating_pair_bins",
    SQL_ENHANCED
    + "SELECT overall, CAST(least(floor((enhanced_rating - 1.0) / (4.0::DOUBLE / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM enhanced GROUP BY 1, 2",
)
def rating_pair_bin_counts(spark, sf_dir):
    return rating_pair_bins(enhanced_reviews(spark, sf_dir))


@query(
    "attach_scores",
    SQL_ENHANCED
    + 'SELECT r.review_id, r."reviewText", r.asin, vader_compound, textblob_polarity, enhanced_rating FROM rated r LEFT JOIN enhanced USING (review_id)',
)
def attach_scores(spark, sf_dir):
    """Scores back on full rows: the one place where the text is shuffled, by its own key."""
    scores = enhanced_reviews(spark, sf_dir).select(
        "review_id", "vader_compound", "textblob_polarity", "enhanced_rating"
    )
    return rated_reviews(spark, sf_dir).select("review_id", "reviewText", "asin").join(
        scores, "review_id", "left"
    )


@query(
    "clamp",
    SQL_SCORED_TEXTS
    + "SELECT review_id, round(greatest(-1.0, least(valence_sum, 1.0)), 6) AS clamped FROM scored",
)
def clamp(spark, sf_dir):
    return _scored_texts(spark, sf_dir).select(
        "review_id", F.round(S.clamp(F.col("valence_sum"), -1.0, 1.0), 6).alias("clamped")
    )


@query(
    "round4",
    SQL_SCORED_TEXTS + "SELECT review_id, round(compound, 4) AS compound FROM scored",
)
def round4(spark, sf_dir):
    return _scored_texts(spark, sf_dir).select("review_id", F.round("compound", 4).alias("compound"))


@query(
    "rescale",
    SQL_SCORED_TEXTS
    + "SELECT review_id, round(((compound + 1) / 2) * 4 + 1, 6) AS as_rating, round(((((compound + 1) / 2) * 4 + 1) - 1) / 4, 6) AS as_unit FROM scored",
)
def rescale(spark, sf_dir):
    rating = S.score_to_rating(F.col("compound"))
    return _scored_texts(spark, sf_dir).select(
        "review_id",
        F.round(rating, 6).alias("as_rating"),
        F.round(S.rating_to_unit(rating), 6).alias("as_unit"),
    )
