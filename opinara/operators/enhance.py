"""Rating enhancement from star values and text opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.config import EnhanceConfig
from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.operators.quantiles import describe

ENHANCED_COLUMNS = (
    "vader_compound",
    "textblob_polarity",
    "text_sentiment_score",
    "text_based_rating",
    "text_confidence",
    "effective_text_weight",
    "effective_rating_weight",
    "enhanced_rating",
)


def enhance_confidence(
    scored: DataFrame,
    rating: str = "overall",
    compound: str = "compound",
    polarity: str = "polarity",
    words: str = "n_words",
    config: EnhanceConfig = EnhanceConfig(),
) -> DataFrame:
    """Append the eight rounded blend columns and ``rating_diff``; one projection."""
    columns = S.blend(F.col(rating), F.col(compound), F.col(polarity), F.col(words), config)
    rounded = scored.withColumns({name: F.round(expr, 4) for name, expr in columns.items()})
    return rounded.withColumn("rating_diff", F.abs(F.col("enhanced_rating") - F.col(rating)))


def enhance_alpha(
    scored: DataFrame, rating: str = "overall", compound: str = "compound", alpha: float = C.ALPHA_BLEND
) -> DataFrame:
    blended = scored.withColumn("enhanced_rating", S.alpha_blend(F.col(rating), F.col(compound), alpha))
    return blended.withColumn("rating_diff", F.abs(F.col("enhanced_rating") - F.col(rating)))


def high_disagreement(enhanced: DataFrame, threshold: float = C.DISAGREEMENT_THRESHOLD) -> DataFrame:
    return enhanced.where(F.col("rating_diff") > threshold).orderBy(
        F.desc("rating_diff"), F.asc("review_id")
    )


def enhancement_summary(enhanced: DataFrame) -> DataFrame:
    return enhanced.agg(
        F.avg("overall").alias("mean_original_rating"),
        F.avg("enhanced_rating").alias("mean_enhanced_rating"),
        F.avg("rating_diff").alias("mean_rating_diff"),
        F.max("rating_diff").alias("max_rating_diff"),
        F.avg("text_confidence").alias("mean_text_confidence"),
    )


def enhanced_vs_original(enhanced: DataFrame) -> DataFrame:
    return describe(enhanced, ["overall", "enhanced_rating"])
