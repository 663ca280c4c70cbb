"""The full run: label, sample, split, fit, compare, enhance, save."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.config import RunConfig
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.operators import enhance as E
from opinara.operators import evaluate as V
from opinara.operators import lexicon as L
from opinara.operators import models as M
from opinara.operators import sampling
from opinara.operators.transformers import CLEANED
from opinara.session import checkpointed
from opinara.sources import results as R

MODEL_COLUMNS = {
    "VADER": "vader",
    "TextBlob": "textblob",
    "Naive Bayes": "nb_sentiment",
    "MLP": "mlp_sentiment",
}


def balanced_split(reviews: DataFrame, config: RunConfig, strict: bool = True) -> DataFrame:
    """Balanced subset with a ``split`` column, written once because everything reads it."""
    labelled = reviews.withColumn("sentiment", S.label_sentiment(F.col("overall")))
    subset = sampling.sample_balanced(labelled, config.n_per_class, seed=config.seed, strict=strict)
    return checkpointed(sampling.split_stratified(checkpointed(subset), config.test_fraction, seed=config.seed))


def run(
    reviews: DataFrame,
    lexicon: DataFrame,
    output_dir: str,
    config: RunConfig = RunConfig(),
    strict: bool = True,
) -> DataFrame:
    """Run all steps on (review_id, overall, reviewText, ...); returns the comparison.

    Writes model, metrics.csv, class_report, enhanced_ratings.csv and metadata.json below
    ``output_dir``.
    """
    subset = balanced_split(reviews, config, strict)
    train, test = (subset.where(F.col("split") == part) for part in ("train", "test"))
    fitted = M.train_models(train, config=config)
    fitted.model.write().overwrite().save(f"{output_dir}/model")

    # The lexicons read the same cleaned text as the classifiers.
    prepared = fitted.features.stages[0].transform(test).select("review_id", F.col(CLEANED).alias("cleaned_text"))
    opinions = L.predict_from_scores(L.lexicon_scores(prepared, lexicon, "cleaned_text"))
    predicted = M.classify_frame(test, fitted.model).join(
        opinions.select("review_id", "vader", "textblob"), "review_id"
    )
    long = checkpointed(V.long_predictions(predicted, "sentiment", MODEL_COLUMNS))
    comparison = checkpointed(V.compare_models(long))
    R.write_metrics(comparison, f"{output_dir}/metrics.csv")
    V.classification_report(long).write.mode("overwrite").parquet(f"{output_dir}/class_report")

    enhanced = checkpointed(enhance(subset, lexicon, config))
    R.write_enhanced(enhanced, f"{output_dir}/enhanced_ratings.csv")
    best = {}
    for name, search in (("nb", fitted.bayes), ("mlp", fitted.perceptron)):
        best[name] = M.best_candidate(search)
    metadata = R.run_metadata(
        reviews, subset, comparison, E.enhancement_summary(enhanced), best, config
    )
    R.write_metadata(metadata, f"{output_dir}/metadata.json")
    return comparison


def enhance(reviews: DataFrame, lexicon: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Enhanced ratings of (review_id, overall, reviewText)."""
    marked = reviews.select(
        "review_id", "overall", T.prepare_training(F.col("reviewText")).alias("review_neg")
    )
    scored = L.lexicon_scores(marked, lexicon, "review_neg", keep=["overall"])
    return E.enhance_confidence(scored, config=config.enhance)
