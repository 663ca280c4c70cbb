"""Whitening next to dense linear algebra and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import whitening


def spectra():
    rng = np.random.default_rng(2)
    yield "spread", np.sort(rng.exponential(5, 40))[::-1]
    yield "equal", np.array([9.0] * 6 + [4.0] * 12 + [1.0] * 10)
    yield "all equal", np.full(20, 3.0)
    yield "close", np.concatenate([[100.0], 5 + 1e-9 * np.arange(30)])
    yield "steep", 10.0 ** -np.arange(0, 14, 0.5)
    yield "rank 3", np.array([5.0, 2.0, 1.0] + [0.0] * 20)
    yield "one", np.array([2.0])


@pytest.mark.parametrize(("name", "values"), list(spectra()))
def test_components_of_known_spectra(name, values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.leading(a, 32)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:32]
    want = want[want > len(a) * 2.0**-50 * want.max()]
    if name == "rank 3":
        assert len(found) == 3
    assert len(found) == len(want) and np.allclose(found, want, rtol=0, atol=1e-12 * want.max())
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * found).max() < 1e-11 * want.max()


def test_inertia_counts():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (-100, -1.0, 0.0, 0.3, 2.0, 100):
            assert whitening.inertia(a, shift) == (values > shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.inertia(np.zeros((3, 3)), 0.0) == 0


def check(rows, vectors, components=32):
    """`rows` against plain Python for {id: entries}."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[i] for v in x.values()) for i in range(d)]
    y = np.array([[float(Fraction(v[i] * n - sums[i], n)) for i in range(d)] for v in x.values()])
    values, found = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:components]
    want = y @ found[:, order] / np.sqrt(values[order])
    place = {i: k for k, i in enumerate(x)}
    k = len(order)
    got = np.full((n, k), np.nan)
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert abs(r.explained - values[order][r.component - 1] / np.trace(y.T @ y / n)) < 1e-12
        assert 0 <= r.identity_error <= 1e-9
    assert len(rows) == n * k
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7
    assert np.abs(np.cov(got.T, bias=True) - np.eye(k)).max() < 1e-9


def test_table_equals_dense_algebra(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    check(whitening.report(df.withColumn("dim", F.lit("x")).withColumn("_id", F.lit(1)).repartition(3)).collect(), vectors)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = {i: (rng.standard_normal(5) * [3, 2, 1, 1, 0.5] + 7).tolist() for i in range(60)}
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([*base.items(), *odd], "vec_id long, embedding array<double>").repartition(4)
    check(whitening.report(df).collect(), base)
    check([r for r in whitening.report(df, components=2).collect()], base, 2)
    # Each length on its own; repeated and null ids keep their rows.
    more = [(200, [float(k), 1.0]) for k in range(4)] + [(None, [9.0, 5.0]), (None, [9.0, 5.0])]
    both = whitening.report(df.unionByName(spark.createDataFrame(more, df.schema))).collect()
    assert sorted((r.vec_id or -1, r.component) for r in both if r.n == 6) == sorted([(200, 1), (200, 2)] * 4 + [(-1, 1), (-1, 2)] * 2)
    check([r for r in both if r.n == 60], base)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.report(same).collect() == [] and whitening.report(df.limit(0)).collect() == []
    assert whitening.transform(same, whitening.fit(same)).count() == 5


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e300, 0.0]), (2, [-5e12, 1.0]), (3, [2.5e12, 0.015625]), (4, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)[2]
    x = [[max(-(2**50), min(2**50, math.floor(64 * c))) + 1_000_000 for c in v] for _, v in rows]
    assert model.sums == [sum(c) for c in zip(*x, strict=True)]
    assert all(r.deviation is None for r in whitening.report(df).collect() if r.vec_id == 1)
