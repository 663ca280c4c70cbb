"""Whitening of embeddings with components found by contour integration.

1. Every entry c becomes the integer x = floor(64 c) + 1000000.  One pass sums n and x, a second
   the products of x less the integer next to its mean.  Both sums are of integers, so they are
   exact and alike in every run, and the covariance V (divisor n) is rounded once.  Tasks send
   one row per dimension, added up before they reach the driver, which only ever holds the
   d x d covariance.
2. The interval that holds the leading eigenvalues is cut until no part holds more than `PART`.
   Counts come from the inertia of shifted matrices: as many eigenvalues exceed a shift as the
   diagonal blocks of a pivoted symmetric factorisation of V less the shift have positive ones.
3. For each part, a circle around it is integrated by Gauss-Legendre points: random vectors times
   the sum of complex shifted solves are projected onto the part's eigenvectors.  Rayleigh-Ritz
   in that subspace gives values and vectors; both steps are repeated until residuals vanish.
   A part is done when it has as many values inside as its inertia count says, so none is missed.
4. A last Rayleigh-Ritz over all parts makes vectors of different parts orthogonal.
5. Rows are projected on the components, over the root of the eigenvalue, with vectors shipped by
   broadcast (d x k doubles).  A last pass over the rows measures how far the covariance of the
   whitened values is from the identity.

Defined results: vectors that are null or hold null or non-finite entries are dropped; empty
vectors have no components; vectors of each length are a fit list of their own; entries that
reach beyond 2^50 after scaling stop there; a component whose eigenvalue is not above rounding
(d x 2^-50 of the largest) cannot be whitened and is left out, so equal vectors have none; of
equal eigenvalues any orthonormal basis is taken; a deviation that no long holds is null;
repeated and null ids keep a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
PART = 8  # eigenvalues in a contour
POINTS = 8  # of the quadrature, on half a circle
ROUNDS = 40
LARGEST = 2**50


@dataclass
class Whitening:
    """What was fitted to the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray  # falling
    vectors: np.ndarray  # one column each
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of rows of integers x; differences from the mean are rounded once."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.vectors / np.sqrt(self.values)


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix exceed the shift.

    Factors with 1 x 1 and 2 x 2 pivots, the largest entry first; the number of positive
    eigenvalues of the pivots is that of the matrix.
    """
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        size = len(m)
        diagonal = np.abs(np.diag(m))
        k = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        i, j = divmod(int(off.argmax()), size)
        if diagonal[k] >= 0.64 * off[i, j]:  # the bound that keeps growth least
            if m[k, k] == 0:
                break  # all that is left is zero
            above += m[k, k] > 0
            rest = np.arange(size) != k
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, k], m[rest, k]) / m[k, k]
        else:
            above += 1  # such a block has one eigenvalue of either sign
            rest = (np.arange(size) != i) & (np.arange(size) != j)
            side = m[np.ix_(rest, [i, j])]
            m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_([i, j], [i, j])], side.T)
            m = (m + m.T) / 2
    return above


def intervals(a: np.ndarray, wanted: int, most: int = PART) -> list[tuple[float, float, int]]:
    """(low, high, number) from the top down, until `wanted` eigenvalues are covered.

    Cuts keep away from eigenvalues: of three places the one with the widest room is taken, as
    told by counts on either side.  Eigenvalues that agree to rounding stay together.
    """
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    room = max(abs(low), abs(high)) * 1e-3 or 1.0
    low, high = low - room, high + room
    least = room * 1e-9
    done: list[tuple[float, float, int]] = []
    stack = [(low, high, 0, len(a))]  # (low, high, above high, above low)
    covered = 0
    while stack and covered < wanted:
        lo, hi, over_hi, over_lo = stack.pop()
        if over_hi == over_lo:
            continue
        if over_lo - over_hi <= most or hi - lo <= least:
            done.append((lo, hi, over_lo - over_hi))
            covered = over_lo
            continue
        step = (hi - lo) / 64
        best = None
        for cut in ((lo + hi) / 2, (lo + hi) / 2 + 3 * step, (lo + hi) / 2 - 3 * step):
            above = inertia(a, cut)
            near = inertia(a, cut - step) - inertia(a, cut + step)
            if best is None or near < best[0]:
                best = (near, cut, above)
            if not near:
                break
        _, cut, above = best
        stack += [(lo, cut, above, over_lo), (cut, hi, over_hi, above)]
    return done


def contour(a: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs of the symmetric matrix in (low, high]."""
    d, centre, radius = len(a), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    scale = max(np.abs(a).sum(axis=1).max(), np.finfo(float).tiny)
    y = rng.standard_normal((d, min(d, count + count // 2 + 4)))
    inside = low, high
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for angle, weight in zip(angles, weights, strict=True):
            turn = radius * np.exp(1j * angle)
            # One half of the circle: the other is its mirror image.
            q += weight / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(d) - a, y.astype(complex))).real
        basis, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(basis.T @ a @ basis)
        vectors = basis @ small
        found = np.flatnonzero((values > inside[0]) & (values <= inside[1]))
        gap = np.linalg.norm(a @ vectors[:, found] - vectors[:, found] * values[found], axis=0)
        if len(found) == count and (gap <= scale * d * 2.0**-50).all():
            return values[found], vectors[:, found]
        y = vectors
        if len(found) >= count and y.shape[1] < d:  # values that only seem to be inside: more room for them
            y = np.concatenate([y, rng.standard_normal((d, min(4, d - y.shape[1])))], axis=1)
    raise RuntimeError(f"{len(found)} of {count} eigenvalues settled in {low}..{high}")


def leading(a: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors; those not above rounding are left out."""
    wanted = min(wanted, len(a))
    scale = float(np.abs(a).max()) if len(a) else 0.0
    if not wanted or not scale:
        return np.zeros(0), np.zeros((len(a), 0))
    a = a / scale
    rng = np.random.default_rng(11)
    parts = [contour(a, low, high, n, rng)[1] for low, high, n in intervals(a, wanted)]
    basis, _ = np.linalg.qr(np.concatenate(parts, axis=1))
    values, small = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-values)[:wanted]
    order = order[values[order] > len(a) * 2.0**-50 * values.max()]
    return values[order] * scale, basis @ small[:, order]


def _entries(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(rows that remain, {length: (their places, integers x)})."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()  # without the entries of null rows
    c = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
    good = np.isfinite(c) if flat.null_count == 0 else np.isfinite(c) & np.asarray(flat.is_valid())
    start = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(~good)])
    ok = np.asarray(column.is_valid()) & (size > 0) & (bad[start + size] == bad[start])
    out = {}
    for dim in np.unique(size[ok]).tolist():
        at = np.flatnonzero(ok & (size == dim))
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * c[start[at][:, None] + np.arange(dim)]), -LARGEST, LARGEST)
        out[dim] = at, x.astype(np.int64) + SHIFT
    return ok, out


_SUMS = "dim int, i int, j int, value decimal(38,0)"


def _rows(dim: int, sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([dim] * len(keys), pa.int32()),
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([decimal.Decimal(v) for v in sums.values()], pa.decimal128(38, 0)),
        ],
        names=["dim", "i", "j", "value"],
    )


def _sum_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: number of rows (i = -1) and sums of x."""
    held: dict[int, list[int]] = {}
    for batch in batches:
        for dim, (at, x) in _entries(batch.column("vector"))[1].items():
            # 2^12 rows of 2^51 at most stay within 64 bits.
            total = [sum(c) for c in zip(*(x[a : a + 4096].sum(axis=0).tolist() for a in range(0, len(x), 4096)), strict=True)]
            old = held.get(dim, [0] * (dim + 1))
            held[dim] = [a + b for a, b in zip(old, [len(at), *total], strict=True)]
    for dim, total in held.items():
        yield _rows(dim, {(i - 1, -1): v for i, v in enumerate(total)})


def _sum_products(centres):
    """Per length: exact sums of the products of centred entries i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, (_, x) in _entries(batch.column("vector"))[1].items():
                y = x - centres.value[dim]
                most = max(int(np.abs(y).max()), 1)
                step = 2**53 // most**2
                if step:  # doubles hold such sums exactly
                    step = min(step, len(y))
                    sums = [(p.T @ p).astype(np.int64).astype(object) for p in (y[a : a + step].astype(float) for a in range(0, len(y), step))]
                else:
                    sums = [np.array(y, dtype=object).T @ np.array(y, dtype=object)]
                held[dim] = sum(sums, held.get(dim, 0))
        for dim, total in held.items():
            yield _rows(dim, {(i, j): int(total[i, j]) for i in range(dim) for j in range(i, dim)})

    return run


def _selected(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Whitening]:
    """A whitening for each length of vectors."""
    rows = _selected(vectors, id_col, vector_col).select("vector")

    def added(task) -> dict[int, dict[tuple[int, int], int]]:
        # At most one row per entry of a covariance, whatever the number of vectors.
        out: dict[int, dict[tuple[int, int], int]] = {}
        for r in rows.mapInArrow(task, _SUMS).groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
            out.setdefault(r.dim, {})[r.i, r.j] = int(r.value)
        return out

    known = {dim: (s[-1, -1], [s[i, -1] for i in range(dim)]) for dim, s in added(_sum_entries).items()}
    centres = {dim: np.array([round(Fraction(s, n)) for s in sums]) for dim, (n, sums) in known.items()}
    products = added(_sum_products(rows.sparkSession.sparkContext.broadcast(centres))) if known else {}
    out = {}
    for dim, (n, sums) in known.items():
        rest = [s - n * int(m) for s, m in zip(sums, centres[dim], strict=True)]
        v = np.empty((dim, dim))
        for (i, j), p in products[dim].items():
            v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / n**2  # one rounding
        values, found = leading(v, components)
        out[dim] = Whitening(n, sums, values, found, float(np.trace(v)))
    return out


def _measure(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, (_, x) in _entries(batch.column("vector"))[1].items():
                w = fitted.value[dim].project(x)
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                held[dim] = held.get(dim, 0) + w.T @ w
        for dim, total in held.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["dim", "i", "j", "value"])

    return run


def identity_error(vectors: DataFrame, fitted: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, float]:
    """For each length the largest absolute entry of the whitened values' covariance less the identity."""
    rows = _selected(vectors, id_col, vector_col).select("vector")
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    sums = rows.mapInArrow(_measure(shared), "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    entries: dict[int, dict[tuple[int, int], float]] = {}
    for r in sums.collect():
        entries.setdefault(r.dim, {})[r.i, r.j] = r.value
    out = {}
    for dim, s in entries.items():
        n, k = s[0, 0], len(fitted[dim].values)
        # Values are centred already; what rounding left of their means goes out here.
        cov = [s[i, j] / n - s[0, i] / n * s[0, j] / n - (i == j) for i in range(1, k + 1) for j in range(i, k + 1)]
        out[dim] = max(map(abs, cov), default=0.0)
    return out


def _deviation(n: int, sums: list[int], x: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact."""
    whole = np.array([s // n for s in sums])
    y = x - whole
    short = ((np.abs(y) + 1.0) ** 2).sum(axis=1) * float(n) ** 2 < 2.0**62  # 64 bits hold these
    d = np.where(short[:, None], y, 0) * n - np.array([s % n for s in sums])
    out = (d * d).sum(axis=1).tolist()
    for k in np.flatnonzero(~short).tolist():
        exact = sum((n * a - s) ** 2 for a, s in zip(x[k].tolist(), sums, strict=True))
        out[k] = exact if exact < 2**63 else None
    return out


def _whitened(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (at, x) in _entries(batch.column("vector"))[1].items():
                model = fitted.value[dim]
                w = model.project(x)
                values = pa.ListArray.from_arrays(np.arange(0, w.size + 1, max(w.shape[1], 1))[: len(w) + 1] if w.size else np.zeros(len(w) + 1, dtype=np.int64), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(at)),
                        pa.array([dim] * len(at), pa.int32()),
                        pa.array([model.n] * len(at), pa.int64()),
                        pa.array(_deviation(model.n, model.sums, x), pa.int64()),
                        values.cast(pa.list_(pa.float64())),
                    ],
                    names=["_id", "dim", "n", "deviation", "whitened"],
                )

    return run


def transform(vectors: DataFrame, fitted: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, n, deviation, whitened), one row per remaining vector; whitened is an array."""
    rows = _selected(vectors, id_col, vector_col)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_whitened(shared), f"_id {kind}, dim int, n long, deviation long, whitened array<double>")
    return out.withColumnRenamed("_id", id_col)


def report(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row per vector and component."""
    fitted = fit(vectors, components, id_col, vector_col)
    errors = identity_error(vectors, fitted, id_col, vector_col)
    shares = [F.lit(None).cast("array<double>"), F.lit(None).cast("double")]
    for dim, model in fitted.items():
        here = F.col("dim") == dim
        shares[0] = F.when(here, F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")).otherwise(shares[0])
        shares[1] = F.when(here, F.lit(errors.get(dim, 0.0))).otherwise(shares[1])
    rows = transform(vectors, fitted, id_col, vector_col)
    rows = rows.select(id_col, "n", "deviation", shares[0].alias("_share"), shares[1].alias("identity_error"), F.posexplode("whitened").alias("_k", "whitened"))
    return rows.select(id_col, (F.col("_k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("_share", F.col("_k")).alias("explained"), "identity_error")
