"""Multinomial naive Bayes over sparse rows: one pass of sums, one pass of scores.

Rows hold the numbers and weights of their features.  A task adds the weights of its rows up by
(fold, class, feature) and ships what isn't zero, so a fit moves as many numbers as the model has,
whatever the number of rows.  A grid search takes one such pass: the model of a fold's training
part is the total less the fold's own sums, and all smoothing values follow from it by formula.
A second pass scores each row by the models of its own fold, for all smoothing values at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import constants as C
from opinara.functions import scores as S
from opinara.operators.evaluate import class_metrics, model_metrics

_K = len(C.CLASSES)


@dataclass(frozen=True)
class Bayes:
    """Log shares of the classes and log chances of the features in each."""

    prior: np.ndarray
    theta: np.ndarray


def _entries(terms: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight)."""
    return np.asarray(pc.list_parent_indices(terms)), np.asarray(terms.flatten()), np.asarray(weights.flatten())


def _input(rows: DataFrame, fold: Column, label: str, features: str) -> DataFrame:
    index = S.class_index(F.col(label)).cast("int")
    return rows.select(fold.cast("int").alias("fold"), index.alias("label"), F.col(features)["terms"].alias("terms"), F.col(features)["weights"].alias("weights"))


def class_masses(rows: DataFrame, size: int, n_folds: int = 1, fold: Column | None = None, label: str = "sentiment", features: str = "features") -> np.ndarray:
    """Weights by [fold, class, feature]; the last place counts the rows.

    What reaches the driver is bounded by folds x classes x features.
    """
    shape = (n_folds, _K, size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_folds * _K * (size + 1))
        for batch in batches:
            group = np.asarray(batch.column("fold")).astype(np.int64) * _K + np.asarray(batch.column("label"))
            row, term, weight = _entries(batch.column("terms"), batch.column("weights"))
            total += np.bincount(group[row] * (size + 1) + term, weight, minlength=len(total))
            total += np.bincount(group * (size + 1) + size, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["place", "value"])

    given = _input(rows, F.lit(0) if fold is None else fold, label, features)
    sums = given.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out.ravel()[np.asarray(sums["place"], dtype=np.int64)] = np.asarray(sums["value"])
    return out


def smoothed(masses: np.ndarray, alpha: float) -> Bayes:
    """The model of [class, feature] sums whose last place counts rows."""
    mass, rows = masses[:, :-1], masses[:, -1]
    with np.errstate(divide="ignore"):
        prior = np.log(rows / rows.sum())
    return Bayes(prior, np.log((mass + alpha) / (mass.sum(axis=1, keepdims=True) + alpha * mass.shape[1])))


def fit_bayes(rows: DataFrame, size: int, alpha: float = 1.0, label: str = "sentiment", features: str = "features") -> Bayes:
    """Fits (label, features struct<terms, weights>) with features numbered below ``size``."""
    return smoothed(class_masses(rows, size, label=label, features=features)[0], alpha)


def score_bayes(rows: DataFrame, model: Bayes, features: str = "features") -> DataFrame:
    """The other columns with score_<class>... and nb_sentiment."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scores(terms: pa.Array, weights: pa.Array) -> pa.Array:
        row, term, weight = _entries(terms, weights)
        sums = [np.bincount(row, weight * shared.value.theta[k, term], minlength=len(terms)) + shared.value.prior[k] for k in range(_K)]
        return pa.StructArray.from_arrays([pa.array(s) for s in sums], names=[f"score_{c}" for c in C.CLASSES])

    kind = "struct<" + ", ".join(f"score_{c}: double" for c in C.CLASSES) + ">"
    scored = F.arrow_udf(scores, kind)(F.col(features)["terms"], F.col(features)["weights"])
    others = [c for c in rows.columns if c != features]
    return rows.select(*others, scored.alias("_scores")).select(*others, "_scores.*").withColumn("nb_sentiment", argmax_class())


def argmax_class() -> Column:
    """Class with the largest score; alphabetically first on ties."""
    first, second, third = (F.col(f"score_{c}") for c in C.CLASSES)
    return (
        F.when((first >= second) & (first >= third), F.lit(C.CLASSES[0]))
        .when(second >= third, F.lit(C.CLASSES[1]))
        .otherwise(F.lit(C.CLASSES[2]))
    )


def fold_cells(rows: DataFrame, size: int, alphas: Sequence[float], n_folds: int, fold: str = "fold", label: str = "sentiment", features: str = "features") -> DataFrame:
    """(candidate, fold, truth, pred, n): each row labelled by the models fitted without its fold."""
    masses = class_masses(rows, size, n_folds, F.col(fold), label, features)
    models = [[smoothed(masses.sum(axis=0) - masses[f], a) for f in range(n_folds)] for a in alphas]
    prior = np.array([[m.prior for m in fitted] for fitted in models])
    theta = np.array([[m.theta for m in fitted] for fitted in models])
    shared = rows.sparkSession.sparkContext.broadcast((prior, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, theta = shared.value
        cells = np.zeros((len(alphas), n_folds, _K, _K), dtype=np.int64)
        for batch in batches:
            own, truth = np.asarray(batch.column("fold")), np.asarray(batch.column("label"))
            row, term, weight = _entries(batch.column("terms"), batch.column("weights"))
            for a in range(len(alphas)):
                sums = np.array([np.bincount(row, weight * theta[a, own[row], k, term], minlength=len(own)) for k in range(_K)])
                # The first class wins ties, as `argmax_class` has it.
                pred = np.argmax(sums + prior[a, own].T, axis=0)
                np.add.at(cells, (a, own, truth, pred), 1)
        at = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in at], pa.array(cells[at])], names=["candidate", "fold", "truth", "pred", "n"])

    given = _input(rows, F.col(fold), label, features)
    parts = given.mapInArrow(run, "candidate int, fold int, truth int, pred int, n long")
    sums = parts.groupBy("candidate", "fold", "truth", "pred").agg(F.sum("n").alias("n"))
    return sums.select("candidate", "fold", S.class_name(F.col("truth")).alias("truth"), S.class_name(F.col("pred")).alias("pred"), "n")


def search_grid(rows: DataFrame, size: int, alphas: Sequence[float], n_folds: int = 5, fold: str = "fold", label: str = "sentiment", features: str = "features") -> DataFrame:
    """(candidate, alpha, mean_f1, std_f1): support-weighted f1 over the folds, whose deviation is
    that of the population."""
    cells = fold_cells(rows, size, alphas, n_folds, fold, label, features)
    scored = model_metrics(class_metrics(cells.select(F.col("candidate").alias("model_order"), F.col("fold").alias("model"), "truth", "pred", "n")))
    alpha = F.get(F.array(*[F.lit(float(a)) for a in alphas]), F.col("candidate"))
    means = scored.groupBy(F.col("model_order").alias("candidate")).agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))
    return means.select("candidate", alpha.alias("alpha"), "mean_f1", "std_f1")
