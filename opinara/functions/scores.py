"""Labels and rating arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.config import EnhanceConfig
from opinara.functions import constants as C


def label_sentiment(rating: Column) -> Column:
    """>=4 Positive, 3 Neutral, anything else (also null and NaN) Negative."""
    value = F.nanvl(rating.cast("double"), F.lit(None).cast("double"))
    return (
        F.when(value >= 4, F.lit("Positive"))
        .when(value == 3, F.lit("Neutral"))
        .otherwise(F.lit("Negative"))
    )


def threshold_label(score: Column, threshold: float = 0.0, inclusive: bool = False) -> Column:
    """Score to class; ``inclusive`` lets the threshold itself count."""
    high = score >= threshold if inclusive else score > threshold
    low = score <= -threshold if inclusive else score < -threshold
    return F.when(high, F.lit("Positive")).when(low, F.lit("Negative")).otherwise(F.lit("Neutral"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def score_to_rating(score: Column) -> Column:
    """[-1, 1] to [1, 5]."""
    return ((score + 1) / 2) * 4 + 1


def rating_to_unit(rating: Column) -> Column:
    """[1, 5] to [0, 1]."""
    return (rating - 1) / 4


def class_index(label: Column) -> Column:
    """Alphabetical class id."""
    out = F.when(label == C.CLASSES[0], 0.0)
    for i, name in enumerate(C.CLASSES[1:], start=1):
        out = out.when(label == name, float(i))
    return out


def class_name(index: Column) -> Column:
    out = F.when(index == 0.0, F.lit(C.CLASSES[0]))
    for i, name in enumerate(C.CLASSES[1:], start=1):
        out = out.when(index == float(i), F.lit(name))
    return out


def compound(valence_sum: Column) -> Column:
    """Valence sum normalised to [-1, 1]."""
    value = valence_sum / F.sqrt(valence_sum * valence_sum + F.lit(C.COMPOUND_ALPHA))
    return clamp(value, -1.0, 1.0)


def blend(
    stars: Column,
    compound_score: Column,
    polarity: Column,
    words: Column,
    config: EnhanceConfig = EnhanceConfig(),
) -> dict[str, Column]:
    """Unrounded columns of the confidence-weighted blend."""
    strength_w, agreement_w, length_w = C.CONFIDENCE_WEIGHTS
    score = clamp(
        config.compound_weight * compound_score + config.polarity_weight * polarity, -1.0, 1.0
    )
    text_rating = score_to_rating(score)
    length_conf = F.least(words / F.lit(C.LENGTH_FULL_WORDS), F.lit(1.0))
    agreement = 1.0 - F.least(F.abs(compound_score - polarity) / 2.0, F.lit(1.0))
    confidence = clamp(
        strength_w * F.abs(score) + agreement_w * agreement + length_w * length_conf, 0.0, 1.0
    )
    text_weight = (1.0 - config.base_rating_weight) * confidence
    rating_weight = 1.0 - text_weight
    return {
        "vader_compound": compound_score,
        "textblob_polarity": polarity,
        "text_sentiment_score": score,
        "text_based_rating": text_rating,
        "text_confidence": confidence,
        "effective_text_weight": text_weight,
        "effective_rating_weight": rating_weight,
        "enhanced_rating": rating_weight * stars + text_weight * text_rating,
    }


def alpha_blend(stars: Column, compound_score: Column, alpha: float = C.ALPHA_BLEND) -> Column:
    """Fixed-weight blend of stars and compound score, back on the 1..5 scale."""
    unit = alpha * rating_to_unit(stars) + (1 - alpha) * ((compound_score + 1) / 2)
    return F.round(unit * 4 + 1, 4)


def final_label(nb: Column, mlp: Column) -> Column:
    return F.when(nb != mlp, mlp).otherwise(nb)


def chat_message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def summary_prompt(text: Column) -> Column:
    return F.array(chat_message("user", F.concat(F.lit(C.SUMMARY_INSTRUCTION), text)))


def service_prompt(text: Column) -> Column:
    return F.array(
        chat_message("system", F.lit(C.SERVICE_INSTRUCTION)),
        chat_message("user", F.concat(F.lit(C.SERVICE_PREFIX), text)),
    )


def timestamp_string(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def run_timestamp() -> Column:
    return timestamp_string(F.current_timestamp())

