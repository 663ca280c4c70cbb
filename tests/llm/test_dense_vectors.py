"""Pairs among vectors that share a direction."""

from collections import Counter

import numpy as np
import pytest

from opinara.llm import vectors


def dense(n=3000, pairs=200, dim=64, background=0.8):
    """Unit vectors at a cosine of about `background` to each other, and planted pairs at 0.955."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    shared = np.eye(dim)[0]
    off = lambda k: unit(np.pad(rng.standard_normal((k, dim - 1)), ((0, 0), (1, 0))))
    a, other = off(n), off(pairs)
    r = (0.955 - background) / (1 - background)
    first = a[:pairs]
    side = unit(other - (other * first).sum(axis=1, keepdims=True) * first)
    twin = r * first + np.sqrt(1 - r * r) * side
    return np.sqrt(background) * shared + np.sqrt(1 - background) * np.concatenate([a, twin])


def test_pairs_of_a_common_direction_are_found(spark):
    n, pairs = 3000, 200
    x = dense(n, pairs)
    df = spark.createDataFrame([*enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, window=4).collect()}
    assert sum(got[n + k] > 0 for k in range(pairs)) >= 0.9 * pairs


def crowded(directions, inner, n=60_000, pairs=300, dim=64):
    """Vectors around several directions, and planted pairs at 0.955."""
    rng = np.random.default_rng(directions)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    heads = unit(rng.standard_normal((directions, dim)))
    around = lambda m: unit(np.sqrt(inner) * heads[rng.integers(0, directions, m)] + np.sqrt(1 - inner) * unit(rng.standard_normal((m, dim))))
    first = around(pairs)
    side = rng.standard_normal(first.shape)
    side = unit(side - (side * first).sum(axis=1, keepdims=True) * first)
    return np.concatenate([around(n), first, 0.955 * first + np.sqrt(1 - 0.955**2) * side])


def plan_of(x):
    sample = x[np.random.default_rng(5).permutation(len(x))[: vectors.SAMPLE]]
    return vectors.Plan({x.shape[1]: sample}, {x.shape[1]: len(x) / len(sample)})


@pytest.mark.parametrize(("directions", "inner"), [(1, 0.8), (20, 0.85), (50, 0.8)])
def test_recall_around_several_directions(directions, inner, n=60_000, pairs=300):
    x = crowded(directions, inner, n, pairs)
    plan = plan_of(x)
    met = np.zeros(pairs, dtype=bool)
    for number in range(vectors.passes_for(plan, 64)):
        place = np.empty(len(x), dtype=np.int64)
        place[np.argsort(plan.codes(x, number), kind="stable")] = np.arange(len(x))
        met |= np.abs(place[n : n + pairs] - place[n + pairs :]) <= vectors.WINDOW
    assert met.mean() >= 0.97


def test_passes_grow_with_count_and_density():
    def passes(inner, n):
        plan = plan_of(crowded(1, inner, 5000))
        return vectors.passes_for(vectors.Plan(plan.sample, {64: n / vectors.SAMPLE}), 64)

    assert passes(0.0, 1000) == vectors.PASSES
    assert passes(0.0, 200_000) < passes(0.7, 200_000) < passes(0.85, 200_000)
    assert passes(0.8, 200_000) < passes(0.8, 2_000_000)


def test_cosines_at_the_threshold_are_told_alike(spark):
    # Pairs whose cosine is the threshold up to rounding: a pair links if its count says so too.
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        a = np.zeros(8)
        a[:2] = rng.standard_normal(2)
        a /= np.linalg.norm(a)
        side = np.zeros(8)
        side[2 + k % 6] = 1.0
        rows += [(2 * k, (a * 3).tolist()), (2 * k + 1, (0.95 * a + np.sqrt(1 - 0.95**2) * side).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.near_duplicates(df, tile=9).collect()
    groups = Counter(r.component_id for r in got)
    assert all((r.n_links > 0) == (groups[r.component_id] > 1) for r in got)
