"""Feature, naive Bayes and perceptron models, grid search and frame classification."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.config import RunConfig, TfidfConfig
from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.functions import text as T
from opinara.operators.bayes import search_grid
from opinara.operators import perceptron as P
from opinara.operators.features import NUMERIC_FEATURES, fit_vocabulary, vocab_stats
from opinara.operators.sampling import assign_folds
from opinara.operators.transformers import (
    CLEANED,
    MARKED,
    TERMS,
    DropColumns,
    ReviewText,
    SublinearCounts,
)
from opinara.session import checkpointed

OUTPUTS = ("nb_sentiment", "mlp_sentiment", "final_sentiment", "models_agree")
_WORKING = [MARKED, CLEANED, TERMS, "_counts", "_damped", "_weighted", "_tfidf", "features"]
_SCORES = ["nb_raw", "nb_probability", "nb_index", "mlp_raw", "mlp_probability", "mlp_index"]


def _scaling(limits: dict[str, tuple[float, float]]) -> SQLTransformer:
    """Min-max scaling with the training limits written into the stage.

    Below-minimum values become 0 because multinomial naive Bayes takes no negative input.
    """
    parts = []
    for name, (low, high) in limits.items():
        width = high - low if high > low else 1.0
        parts.append(f"greatest((CAST({name} AS DOUBLE) - {low!r}D) / {width!r}D, 0.0D) AS {name}_scaled")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_features(
    train: DataFrame, text_col: str = "reviewText", config: TfidfConfig = TfidfConfig(), profile: str = "training"
) -> tuple[PipelineModel, DataFrame]:
    """Fit text features on training rows; returns the stages and the featurised rows.

    Driver-side values are the vocabulary (bounded by ``max_features``) with its idf, the lemma
    table of the training rows, and six scaling limits.
    """
    reader = ReviewText(inputCol=text_col, profile=profile)
    reader = ReviewText(inputCol=text_col, profile=profile, lemmas=reader.lemma_table(train))
    prepared = reader.transform(train).persist()
    limits_row = prepared.agg(
        *[F.min(c).alias(f"{c}_lo") for c in NUMERIC_FEATURES],
        *[F.max(c).alias(f"{c}_hi") for c in NUMERIC_FEATURES],
    ).first()
    limits = {c: (float(limits_row[f"{c}_lo"]), float(limits_row[f"{c}_hi"])) for c in NUMERIC_FEATURES}
    # The relational vocabulary has a rule for equal frequencies.
    vocabulary = fit_vocabulary(vocab_stats(prepared, CLEANED), prepared, config).collect()
    if not vocabulary:
        raise ValueError("no term of the training rows lies within the frequency limits")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in vocabulary], inputCol=TERMS, outputCol="_counts")
    weights = Vectors.dense([r["idf"] for r in vocabulary])
    stages = [
        reader,
        counter,
        SublinearCounts(inputCol="_counts", outputCol="_damped"),
        ElementwiseProduct(inputCol="_damped", outputCol="_weighted", scalingVec=weights),
        Normalizer(inputCol="_weighted", outputCol="_tfidf", p=2.0),
        _scaling(limits),
        VectorAssembler(
            inputCols=["_tfidf", *[f"{c}_scaled" for c in NUMERIC_FEATURES]], outputCol="features"
        ),
    ]
    model = PipelineModel(stages=stages)
    featurised = model.transform(train)
    prepared.unpersist()
    return model, featurised


@dataclass(frozen=True)
class Grid:
    """Candidates of a search with mean and deviation of f1 over the folds, and the model refitted
    on all rows with the first of the best."""

    params: list[dict[str, Any]]
    means: list[float]
    stds: list[float]
    model: Any
    history: list[float] = field(default_factory=list)  # losses of the refit, where it has steps

    @property
    def best(self) -> int:
        """Means are compared to nine digits, since sums over folds differ in their order."""
        return best_of(self.means)


def best_of(means: Sequence[float]) -> int:
    return max(range(len(means)), key=lambda i: (round(means[i], 9), -i))


def search_bayes(rows: DataFrame, config: RunConfig) -> Grid:
    """Smoothing grid over stratified folds from one pass of sums and one of scores (see
    `operators.bayes`); the best value is refitted as a stage for saved models."""
    vector = F.unwrap_udt("features")
    size = int(rows.select(F.coalesce(vector["size"], F.size(vector["values"]))).first()[0])
    terms = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    sparse = rows.select("fold", S.class_name(F.col("label")).alias("sentiment"), F.struct(terms.alias("terms"), vector["values"].alias("weights")).alias("_vector"))
    found = search_grid(sparse, size, config.nb_alphas, config.n_folds, features="_vector").orderBy("candidate").collect()
    means, stds = [r["mean_f1"] for r in found], [r["std_f1"] for r in found]
    nb = NaiveBayes(
        modelType="multinomial",
        featuresCol="features",
        labelCol="label",
        predictionCol="nb_index",
        probabilityCol="nb_probability",
        rawPredictionCol="nb_raw",
        smoothing=float(config.nb_alphas[best_of(means)]),
    )
    return Grid([{"smoothing": float(a)} for a in config.nb_alphas], means, stds, nb.fit(rows))


def _given(mlp: MultilayerPerceptronClassifier, rows: DataFrame, weights: np.ndarray | None = None) -> Any:
    """Spark's model with the given weights, or those it begins with; no step is made."""
    mlp = mlp.copy({mlp.maxIter: 0})
    return (mlp if weights is None else mlp.setInitialWeights(Vectors.dense(weights))).fit(rows.limit(1))


def search_perceptron(rows: DataFrame, n_features: int, config: RunConfig) -> Grid:
    """Grid over hidden layers and iteration limits; the fits of a candidate make their steps
    together (`operators.perceptron`), `parallelism` candidates at most are fitted at once, fewer candidates
    and folds where the driver would hold more than `P.HELD` for their steps; the best is refitted on all
    rows and becomes a stage for saved models."""
    mlp = MultilayerPerceptronClassifier(
        featuresCol="features",
        labelCol="label",
        predictionCol="mlp_index",
        probabilityCol="mlp_probability",
        rawPredictionCol="mlp_raw",
        seed=config.seed,
        blockSize=128,
    )
    layers = [[n_features, *hidden, len(C.CLASSES)] for hidden in config.mlp_hidden]
    grid = (
        ParamGridBuilder()
        .addGrid(mlp.layers, layers)
        .addGrid(mlp.maxIter, list(config.mlp_max_iter))
        .build()
    )
    data = P.blocks(rows)
    starts = {tuple(sizes): _given(mlp.copy({mlp.layers: sizes}), rows).weights.toArray() for sizes in layers}

    folds = range(config.n_folds)
    apart = P.apart(data, n_features, folds) if data.getNumPartitions() > 1 else None

    def fitted(params: dict, left_out: Sequence[int | None]) -> list[tuple[np.ndarray, list[float]]]:
        sizes = params[mlp.layers]
        losses = P.losses_of(apart if apart and left_out is folds else data, sizes, left_out)
        return P.fitted(losses, [starts[tuple(sizes)]] * len(left_out), params[mlp.maxIter], mlp.getTol(), P.at_once(len(starts[tuple(sizes)])))

    def held_out(params: dict) -> list[float]:
        return [P.held_out_f1(data, flat, params[mlp.layers], fold) for fold, (flat, _) in zip(folds, fitted(params, folds), strict=True)]

    most = P.at_once(max(map(len, starts.values()))) // config.n_folds
    with ThreadPoolExecutor(max(1, min(config.parallelism, most))) as side_by_side:
        f1 = np.array(list(side_by_side.map(held_out, grid)))
    means, stds = f1.mean(axis=1).tolist(), f1.std(axis=1).tolist()
    best = grid[best_of(means)]
    if apart:
        apart.rows.unpersist()
    weights, history = fitted(best, [None])[0]
    data.unpersist()
    model = _given(mlp.copy(best), rows, weights)
    model.clear(model.initialWeights)
    model.set(model.maxIter, best[mlp.maxIter])
    return Grid([{p.name: v for p, v in x.items()} for x in grid], means, stds, model, history)


@dataclass
class TrainedModels:
    """Everything one training run yields."""

    model: PipelineModel
    features: PipelineModel
    bayes: Grid
    perceptron: Grid
    config: RunConfig = field(default_factory=RunConfig)


def training_rows(train: DataFrame, config: RunConfig) -> DataFrame:
    """Add class index and fold."""
    return assign_folds(
        train.withColumn("label", S.class_index(F.col("sentiment"))),
        config.n_folds,
        seed=config.seed,
    )


def train_models(
    train: DataFrame, text_col: str = "reviewText", config: RunConfig = RunConfig(), profile: str = "training"
) -> TrainedModels:
    """Fit features, search both classifiers, and assemble one model for raw text.

    ``train`` has review_id, sentiment and the text column.
    """
    narrow = train.select("review_id", "sentiment", text_col)
    folded = checkpointed(training_rows(narrow, config))  # partitions by size, whatever the shuffles had
    features, featurised = fit_features(folded, text_col, config.tfidf, profile)
    rows = featurised.select("review_id", "label", "fold", "features").persist()
    n_features = len(features.stages[1].vocabulary) + len(NUMERIC_FEATURES)
    bayes = search_bayes(rows, config)
    perceptron = search_perceptron(rows, n_features, config)
    rows.unpersist()
    stages = [
        *features.stages,
        bayes.model,
        perceptron.model,
        IndexToString(inputCol="nb_index", outputCol="nb_sentiment", labels=list(C.CLASSES)),
        IndexToString(inputCol="mlp_index", outputCol="mlp_sentiment", labels=list(C.CLASSES)),
        SQLTransformer(
            statement=(
                "SELECT *, CASE WHEN nb_sentiment <> mlp_sentiment THEN mlp_sentiment "
                "ELSE nb_sentiment END AS final_sentiment, "
                "nb_sentiment = mlp_sentiment AS models_agree FROM __THIS__"
            )
        ),
        DropColumns(
            names=[*_WORKING, *NUMERIC_FEATURES, *[f"{c}_scaled" for c in NUMERIC_FEATURES], *_SCORES]
        ),
    ]
    return TrainedModels(PipelineModel(stages=stages), features, bayes, perceptron, config)


def resolve_text_column(columns: list[str], text_column: str | None = None) -> str:
    """The given column, or the first known text column; metadata only."""
    wanted = [text_column] if text_column else list(C.TEXT_COLUMNS)
    present = [c for c in wanted if c in columns]
    if not present:
        raise ValueError(f"no text column: looked for {', '.join(wanted)} among {', '.join(columns)}")
    return present[0]


def classify_frame(df: DataFrame, model: PipelineModel, text_column: str | None = None) -> DataFrame:
    """Append the four prediction columns to any frame with a text column; map-only.

    The input travels in one struct past the model's stages, so its columns may have any
    names, those of working columns included.
    """
    column = resolve_text_column(df.columns, text_column)
    kept = [c for c in df.columns if c not in OUTPUTS]
    reader = model.stages[0].copy({model.stages[0].inputCol: "_input_text"})
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_input_row"), T.fill_text(F.col(f"`{column}`")).alias("_input_text")
    )
    scored = PipelineModel(stages=[reader, *model.stages[1:]]).transform(packed)
    return scored.select(*[F.col("_input_row")[c].alias(c) for c in kept], *OUTPUTS)


def best_candidate(search: Grid) -> tuple[dict[str, str], float]:
    """Parameters and mean f1 of the first candidate with the highest mean."""
    return {name: str(v) for name, v in search.params[search.best].items()}, search.means[search.best]


def grid_results(search: Grid, model: str) -> DataFrame:
    """(model, candidate, params, mean_f1, std_f1, is_best); first candidate wins ties."""
    rows = [
        (model, i, ", ".join(f"{name}={v}" for name, v in sorted(params.items())), mean, std, i == search.best)
        for i, (params, mean, std) in enumerate(zip(search.params, search.means, search.stds, strict=True))
    ]
    return _active().createDataFrame(
        rows, "model string, candidate int, params string, mean_f1 double, std_f1 double, is_best boolean"
    )


def _active() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def bayes_curve(search: Grid) -> DataFrame:
    """(alpha, mean_f1, low, high) of the smoothing grid."""
    rows = [(p["smoothing"], m, m - d, m + d) for p, m, d in zip(search.params, search.means, search.stds, strict=True)]
    return _active().createDataFrame(rows, "alpha double, mean_f1 double, low double, high double")


def loss_curve(search: Grid) -> DataFrame:
    """(iteration, loss) of the refitted perceptron."""
    return _active().createDataFrame(
        [(i, float(v)) for i, v in enumerate(search.history)], "iteration int, loss double"
    )


def feature_matrix(features: PipelineModel, df: DataFrame) -> DataFrame:
    """(review_id, size, stored entries) of the assembled vectors, read inside the JVM."""
    vectors = features.transform(df).select("review_id", F.unwrap_udt("features").alias("v"))
    return vectors.select(
        "review_id",
        F.coalesce("v.size", F.size("v.values")).alias("n_features"),
        F.size("v.values").alias("n_stored"),
    )

