import tracemalloc

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinara.config import RunConfig
from opinara.operators import models as M
from opinara.operators import perceptron as P


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    made = []
    for i in range(1100):
        y = i % 3
        x = {int(k): float(v) for k, v in zip(rng.choice(12, 4, replace=False), rng.random(4), strict=True)}
        x[y] = 0.6 + x.get(y, 0.0)
        made.append((i, float(y), i // 3 % 3, Vectors.sparse(12, x) if i % 5 else Vectors.dense(Vectors.sparse(12, x).toArray())))
    return spark.createDataFrame(made, ["review_id", "label", "fold", "features"]).repartition(3).persist()


def test_slope_is_the_gradient(rows):
    parts = P.blocks(rows).collect()
    assert sum(len(p[1]) for p in parts) == 1100 and max(len(p[1]) for p in parts) <= P.BLOCK
    sizes = [12, 5, 4, 3]
    flat = np.random.default_rng(2).normal(0, 0.5, sum(a * b + b for a, b in zip(sizes, sizes[1:], strict=False)))
    n, loss, total = P.slope(parts, flat, sizes)
    for k in range(0, len(flat), 7):
        near = [flat.copy(), flat.copy()]
        near[0][k] -= 1e-5
        near[1][k] += 1e-5
        low, high = (P.slope(parts, x, sizes)[1] for x in near)
        assert (high - low) / 2e-5 == pytest.approx(total[k], abs=2e-3)
    assert n == 1100 and loss > 0


def test_search_next_to_the_solver_of_spark(rows):
    """No fit runs in Spark's dense solver, which failed by time; models and losses are as good."""
    config = RunConfig(mlp_hidden=((4,), (5, 4)), mlp_max_iter=(60,), n_folds=3)
    found = M.search_perceptron(rows, 12, config)
    names = dict(featuresCol="features", labelCol="label", predictionCol="own", probabilityCol="p", rawPredictionCol="r")
    spark_s = MultilayerPerceptronClassifier(layers=found.model.getOrDefault("layers"), seed=config.seed, maxIter=60, blockSize=128, **names).fit(rows)
    history = spark_s.summary().objectiveHistory
    assert found.history[0] == pytest.approx(history[0], rel=0.01)  # the same first weights
    assert found.history[-1] <= history[-1] * 1.2 + 0.01
    assert all(b <= a for a, b in zip(found.history, found.history[1:], strict=False))
    both = spark_s.transform(found.model.transform(rows))
    assert both.where(F.col("own") == F.col("mlp_index")).count() >= 0.9 * 1100
    assert len(found.means) == 2 and all(0.5 < m <= 1 for m in found.means)
    assert not found.model.isSet("initialWeights") and found.model.getOrDefault("maxIter") == 60


def test_fits_of_a_candidate_share_a_job_for_each_step(rows, monkeypatch):
    """One job a step for all folds; each fit alone, which took a job a step before, ends alike."""
    asked = []
    losses_of = P.losses_of

    def counted(*args):
        at = losses_of(*args)
        return lambda points: asked.append(len(points)) or at(points)

    monkeypatch.setattr(P, "losses_of", counted)
    M.search_perceptron(rows, 12, RunConfig(mlp_hidden=((4,),), mlp_max_iter=(8,), n_folds=3))
    assert asked.count(3) >= 8 and asked.count(1) <= len(asked) // 2 + 4
    data, sizes = P.blocks(rows), [12, 4, 3]
    start = np.random.default_rng(3).normal(0, 0.3, 12 * 4 + 4 + 4 * 3 + 3)
    parts = data.collect()
    for k, (n, loss, total) in enumerate(P.slopes(parts, [start] * 3, sizes, range(3))):
        alone = P.slope([p for p in parts if p[0] != k], start, sizes)
        assert n == alone[0] and loss == pytest.approx(alone[1]) and total == pytest.approx(alone[2], abs=1e-4)
    together = P.fitted(losses_of(data, sizes, range(3)), [start] * 3, 5)
    for k, (point, history) in enumerate(together):
        alone = P.fitted(losses_of(data, sizes, [k]), [start], 5)[0]
        assert history == pytest.approx(alone[1], rel=1e-3) and point == pytest.approx(alone[0], abs=0.05)
    data.unpersist()


def test_gradients_lay_out_no_dense_rows():
    """Rows are multiplied as they are: 300 rows of five in 60,000 features take no 300 x 60,000 table."""
    rng, width, h = np.random.default_rng(4), 60_000, 2
    terms = np.array([rng.choice(width, 5, replace=False) for _ in range(300)], dtype="i4")
    weights, labels = rng.random((300, 5), dtype=np.float32), rng.integers(0, 3, 300).astype("i1")
    parts = [(k % 3, labels[a : a + 50].tobytes(), np.full(50, 5, "i4").tobytes(), terms[a : a + 50].tobytes(), weights[a : a + 50].tobytes()) for k, a in enumerate(range(0, 300, 50))]
    sizes, flat = [width, h, 3], rng.normal(0, 0.5, width * h + h + h * 3 + 3)
    tracemalloc.start()
    found = P.slopes(parts, [flat, flat], sizes, [None, 1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    w, b, v, c = *P.unflattened(flat, sizes)[0], *P.unflattened(flat, sizes)[1]
    for left_out, (n, loss, total) in zip((None, 1), found, strict=True):
        has = np.repeat(np.arange(6) % 3 != left_out, 50)
        x = np.zeros((has.sum(), width))
        np.put_along_axis(x, terms[has].astype(int), weights[has], axis=1)
        state = 1 / (1 + np.exp(-(x @ w + b)))
        share = np.exp(state @ v + c)
        share /= share.sum(axis=1, keepdims=True)
        at = np.arange(len(x))
        assert n == len(x) and loss == pytest.approx(-np.log(share[at, labels[has]]).sum())
        share[at, labels[has]] -= 1
        delta = share @ v.T * state * (1 - state)
        assert total == pytest.approx(np.concatenate([(x.T @ delta).ravel(), delta.sum(0), (state.T @ share).ravel(), share.sum(0)]), abs=1e-6)


def test_training_rows_have_partitions_by_size(spark, monkeypatch):
    """Every pass of a training run read its rows in the partitions of a shuffle, however few they are."""
    seen = []

    def stop(folded, *_):
        seen.append((folded.count(), folded.rdd.getNumPartitions()))
        raise InterruptedError

    monkeypatch.setattr(M, "fit_features", stop)
    rows = spark.createDataFrame([(f"r{i}", "Positive", "good cards") for i in range(40)], "review_id string, sentiment string, reviewText string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        with pytest.raises(InterruptedError):
            M.train_models(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0][0] == 40 and seen[0][1] < 40


def test_rows_set_apart_give_the_same_sums(rows, monkeypatch):
    """Tables of several partitions shipped a sum for every fit from every task; now a fit has tasks of its own."""
    data, sizes, folds = P.blocks(rows).repartition(3).persist(), [12, 4, 3], range(3)
    start = np.random.default_rng(5).normal(0, 0.3, 12 * 4 + 4 + 4 * 3 + 3)
    monkeypatch.setattr(P, "_GROUP_ROWS", 600)
    apart = P.apart(data, 12, folds)
    assert apart.groups == 2 and apart.rows.getNumPartitions() == 6
    together, alone = (P.losses_of(x, sizes, folds) for x in (data, apart))
    for points in (dict.fromkeys(folds, start), {1: start}):
        want, got = together(points), alone(points)
        assert list(got) == list(points)
        for k in points:
            assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == pytest.approx(want[k][1], abs=1e-5)
    apart.rows.unpersist()


def test_search_sets_rows_of_several_partitions_apart(rows, monkeypatch):
    asked, losses_of, blocks = [], P.losses_of, P.blocks
    monkeypatch.setattr(P, "blocks", lambda *a: blocks(*a).repartition(2).persist())
    monkeypatch.setattr(P, "losses_of", lambda data, *a: asked.append(type(data)) or losses_of(data, *a))
    found = M.search_perceptron(rows, 12, RunConfig(mlp_hidden=((4,), (5,)), mlp_max_iter=(30,), n_folds=3))
    assert [x is P.Apart for x in asked] == [True, True, False]  # the refit leaves out no rows
    assert all(0.5 < m <= 1 for m in found.means)


def test_driver_holds_little_of_a_fit():
    """Corrections lie in a file: ten pairs, places and directions of a fit took 128 bytes a weight before."""
    n = 400_000
    scale = np.linspace(1, 300, n)
    tracemalloc.start()
    point, history = P.fitted(lambda points: {k: (float(0.5 * (scale * x) @ x), scale * x) for k, x in points.items()}, [np.ones(n)], 30)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * n and history[-1] < 1e-2 * history[0] and len(history) > 12


def test_fits_at_once_by_their_size():
    """All fits of all candidates were made at once, whatever their size."""
    assert P.at_once(150) > 1000 and 1 <= P.at_once(514_435) <= 3
    asked, starts = [], [np.full(3, float(k)) for k in range(1, 6)]
    losses = lambda points: asked.append(sorted(points)) or {k: (float(x @ x), 2.0 * x) for k, x in points.items()}
    want = [x.tolist() for x, _ in P.fitted(losses, starts, 4)]
    assert asked[0] == [0, 1, 2, 3, 4]
    asked.clear()
    assert [x.tolist() for x, _ in P.fitted(losses, starts, 4, most=3)] == want
    assert max(map(len, asked)) == 3 and {k for x in asked for k in x} == {*range(5)}
