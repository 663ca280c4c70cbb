"""Perceptrons over sparse rows: gradients summed in tasks, steps by limited-memory BFGS.

Rows become blocks of one fold each, packed once as plain arrays and kept by Spark.  The fits of one
shape, each without its own fold, go step by step together: one job gives the losses and gradients
of all of them, or of as many as the driver may hold (`HELD`).  A task lays its rows out, by row and by term, multiplies them as they are, sparse,
in single precision with the first layers of all fits side by side and ships a sum for each fit, which
is as large as the model whatever the number of rows; the driver adds up at most `TASKS` of them.

Where rows fill several partitions, those sums would be most of what the driver holds.  Then the rows
of each fit are set apart once (`apart`), in at most `GROUPS` partitions a fit, and a task ships one sum.

Layers, first weights and stopping rules are those of Spark's `MultilayerPerceptronClassifier`:
sigmoid units, a softmax with cross entropy averaged over rows, ten corrections, steps that
satisfy the strong Wolfe conditions.
"""

from __future__ import annotations

import mmap
import tempfile
from collections import deque
from collections.abc import Callable, Generator, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASKS = 16  # whose sums reach the driver for one step
GROUPS = 4  # of the rows of a fit that are set apart
BLOCK = 512  # rows packed together
_GROUP_ROWS = 16384  # of a group at least, where there are so many
_LAID_ROWS = 16384  # of a fit, laid out at once
_TASK_ROWS = 4096  # of a task at least, where there are so many; laid out at once
HELD = 64 << 20  # bytes of the driver for the steps of fits that are made at once
_HANDS = 3  # fits whose next points are worked out at once
_CORRECTIONS = 10
_FLAT = 20  # values of the loss that are compared

Block = tuple[int, bytes, bytes, bytes, bytes]
Laid = tuple[bytes, bytes, bytes, bytes, bytes, bytes, bytes]
Layers = list[tuple[np.ndarray, np.ndarray]]
At = tuple[float, np.ndarray]  # loss and gradient at a point
Losses = Callable[[Mapping[int, np.ndarray]], dict[int, At]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, labels, sizes, terms, weights): up to `BLOCK` rows of a fold as bytes."""
    names = ["fold", "labels", "sizes", "terms", "weights"]
    held: dict[int, list[pa.Table]] = {}

    def block(fold: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        terms, weights = rows["terms"].combine_chunks(), rows["weights"].combine_chunks()
        parts = [(rows["label"].to_numpy(), "i1"), (pc.list_value_length(terms), "i4"), (terms.flatten(), "i4"), (weights.flatten(), "f4")]
        return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), *[pa.array([np.asarray(x).astype(t).tobytes()], pa.binary()) for x, t in parts]], names=names)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for fold in pc.unique(rows["fold"]).to_pylist():
            held.setdefault(fold, []).append(rows.filter(pc.equal(rows["fold"], fold)))
            if sum(x.num_rows for x in held[fold]) >= BLOCK:
                table = pa.concat_tables(held[fold])
                whole = table.num_rows // BLOCK * BLOCK
                yield from (block(fold, table.slice(a, BLOCK)) for a in range(0, whole, BLOCK))
                held[fold] = [table.slice(whole)]
    for fold, parts in held.items():
        if (table := pa.concat_tables(parts)).num_rows:
            yield block(fold, table)


def blocks(rows: DataFrame, features: str = "features") -> RDD[Block]:
    """The (fold, label, vector) rows as kept blocks, dealt evenly over at most `TASKS` partitions."""
    vector = F.unwrap_udt(features)
    terms = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    flat = rows.select(F.col("fold").cast("int"), F.col("label").cast("int"), terms.alias("terms"), vector["values"].alias("weights"))
    parts = min(TASKS, max(1, -(-rows.count() // _TASK_ROWS)))
    packed = flat.repartition(parts).mapInArrow(_pack, "fold int, labels binary, sizes binary, terms binary, weights binary")
    return packed.rdd.map(lambda r: (r[0], *map(bytes, r[1:]))).persist(StorageLevel.MEMORY_AND_DISK)


def unflattened(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    """Weights and offsets of each layer, as views in the order of Spark's weight vector."""
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def _laid_out(parts: Iterable[Block], most: int = _TASK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(folds, labels, sizes, terms, weights) of blocks put together, `most` rows at most."""

    def together(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        folds = np.repeat([b[0] for b in blocks], [len(b[1]) for b in blocks])
        labels, sizes, terms, weights = (np.frombuffer(b"".join(x), t) for x, t in zip([*zip(*blocks, strict=True)][1:], ("i1", "i4", "i4", "f4"), strict=True))
        return folds, labels.astype(np.int64), sizes, terms.astype(np.int64), weights

    held: list[Block] = []
    for part in parts:
        if sum(len(b[1]) for b in held) + len(part[1]) > most and held:
            yield together(held)
            held = []
        held.append(part)
    if held:
        yield together(held)


def _times(sizes: np.ndarray, places: np.ndarray, weights: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sparse rows times a matrix: of each row the rows of `w` that it names are laid out and summed."""
    made = np.zeros((len(sizes), w.shape[1]), dtype=w.dtype)
    named = np.empty((int(sizes.max(initial=0)), w.shape[1]), dtype=w.dtype)
    weights = weights.astype(w.dtype)
    ends = np.cumsum(sizes).tolist()
    a = 0
    for i, b in enumerate(ends):
        if a < b:
            of = named[: b - a]
            w.take(places[a:b], axis=0, out=of, mode="clip")
            np.dot(weights[a:b], of, out=made[i])
            a = b
    return made


def _by_term(sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transposed rows: (rows of each term, their numbers, weights)."""
    order = np.argsort(terms.astype(np.uint16) if width <= 1 << 16 else terms, kind="stable")
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(terms, minlength=width), rows[order], weights[order]


def _forward(z: np.ndarray, layers: Layers) -> tuple[list[np.ndarray], np.ndarray]:
    """What goes into each later layer, and what comes out of the last before its softmax; `z` is the
    rows times the first layer's weights."""
    states, z = [], z + layers[0][1]
    for w, b in layers[1:]:
        with np.errstate(over="ignore"):
            states.append(1 / (1 + np.exp(-z)))
        z = states[-1] @ w + b
    return states, z


def _back(y: np.ndarray, z: np.ndarray, layers: Layers, sums: Layers) -> tuple[float, np.ndarray]:
    """(loss, slope at `z`) of a block; the gradients of all but the first weights go to `sums`."""
    states, out = _forward(z, layers)
    out = out.astype(float)
    out -= out.max(axis=1, keepdims=True)
    share = np.exp(out)
    mass = share.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = float((np.log(mass[:, 0]) - out[at, y]).sum())
    share /= mass
    share[at, y] -= 1
    delta = share.astype(z.dtype)
    for k in range(len(layers) - 1, 0, -1):
        state = states[k - 1]
        sums[k][0][...] += state.T @ delta
        sums[k][1][...] += delta.sum(axis=0)
        delta = (delta @ layers[k][0].T) * state * (1 - state)
    sums[0][1][...] += delta.sum(axis=0)
    return loss, delta


def slopes(parts: Iterable[Block], flats: Sequence[np.ndarray], sizes: Sequence[int], left_out: Sequence[int | None]) -> list[tuple[int, float, np.ndarray]]:
    """(rows, loss, gradient) of each fit, summed over the blocks of all folds but the one it leaves out."""
    layers, totals = [unflattened(x, sizes) for x in flats], [np.zeros_like(x) for x in flats]
    sums, h = [unflattened(x, sizes) for x in totals], sizes[1]
    n, loss = [0] * len(flats), [0.0] * len(flats)
    first = np.concatenate([x[0][0] for x in layers], axis=1)
    made = np.zeros_like(first)
    for folds, y, lengths, terms, weights in _laid_out(parts):
        z = _times(lengths, terms, weights, first)
        delta = np.zeros_like(z)  # and so it stays in the fold that a fit leaves out
        for k, fold in enumerate(left_out):
            mine = slice(k * h, (k + 1) * h)
            has = slice(None) if fold is None else folds != fold
            part, delta[has, mine] = _back(y[has], z[has, mine], layers[k], sums[k])
            n[k], loss[k] = n[k] + len(y[has]), loss[k] + part
        made += _times(*_by_term(lengths, terms, weights, sizes[0]), delta)
    for k, x in enumerate(sums):
        x[0][0][...] = made[:, k * h : (k + 1) * h]
    return list(zip(n, loss, totals, strict=True))


def slope(parts: Iterable[Block], flat: np.ndarray, sizes: Sequence[int]) -> tuple[int, float, np.ndarray]:
    """(rows, loss, gradient), summed over blocks."""
    return slopes(parts, [flat], sizes, [None])[0]


@dataclass(frozen=True)
class Apart:
    """Rows of fits that leave a fold out each: partition i has rows of fit i // groups, by row and
    by term, put together once."""

    rows: RDD[Laid]
    groups: int


def apart(data: RDD[Block], width: int, left_out: Sequence[int]) -> Apart:
    """The blocks of every fold but one for each of `left_out`, laid out and kept by Spark.  A step then
    ships a sum a fit and group: at most `GROUPS` times the models, in more tasks than sums for all."""
    n = data.map(lambda b: len(b[1])).sum()
    groups = min(GROUPS, -(-n // _GROUP_ROWS))

    def dealt(i: int, parts: Iterator[Block]) -> Iterator[tuple[int, Block]]:
        for at, part in enumerate(parts, i):
            for k, fold in enumerate(left_out):
                if part[0] != fold:
                    yield k * groups + at % groups, part

    def laid(parts: Iterator[tuple[int, Block]]) -> Iterator[Laid]:
        for _, y, lengths, terms, weights in _laid_out((b for _, b in parts), _LAID_ROWS):
            counts, rows, by_term = _by_term(lengths, terms, weights, width)
            yield tuple(x.astype(t).tobytes() for x, t in zip((y, lengths, terms, weights, counts, rows, by_term), _LAID, strict=True))

    tasks = len(left_out) * groups
    return Apart(data.mapPartitionsWithIndex(dealt).partitionBy(tasks, int).mapPartitions(laid).persist(StorageLevel.MEMORY_AND_DISK), groups)


_LAID = ("i1", "i4", "i4", "f4", "i4", "i4", "f4")


def _slope_apart(parts: Iterable[Laid], flat: np.ndarray, sizes: Sequence[int]) -> tuple[int, float, np.ndarray]:
    """(rows, loss, gradient) of one fit, summed over rows that were laid out before."""
    layers, total = unflattened(flat, sizes), np.zeros_like(flat)
    sums, n, loss = unflattened(total, sizes), 0, 0.0
    for part in parts:
        y, lengths, terms, weights, counts, rows, by_term = (np.frombuffer(x, t) for x, t in zip(part, _LAID, strict=True))
        z = _times(lengths, terms.astype(np.intp), weights, layers[0][0])
        of, delta = _back(y.astype(np.intp), z, layers, sums)
        sums[0][0][...] += _times(counts, rows.astype(np.intp), by_term, delta)
        n, loss = n + len(y), loss + of
    return n, loss, total


def losses_of(data: RDD[Block] | Apart, sizes: Sequence[int], left_out: Sequence[int | None]) -> Losses:
    """Mean losses and gradients of some of the fits, each at its point, over all rows but those of
    the fold it leaves out; one job.  Rows set apart have to be those of `left_out`."""
    rows, groups = (data.rows, data.groups) if isinstance(data, Apart) else (data, 0)
    context = rows.context

    def at(points: Mapping[int, np.ndarray]) -> dict[int, At]:
        fits, folds = list(points), [left_out[k] for k in points]
        shared = context.broadcast([x.astype(np.float32, copy=False) for x in points.values()])

        def run(parts: Iterator[Block]) -> Iterator[tuple[int, int, float, bytes]]:
            for k, (n, loss, total) in zip(fits, slopes(parts, shared.value, sizes, folds), strict=True):
                yield k, n, loss, total.tobytes()

        def run_apart(i: int, parts: Iterator[Laid]) -> Iterator[tuple[int, int, float, bytes]]:
            k = i // groups
            n, loss, total = _slope_apart(parts, shared.value[fits.index(k)], sizes)
            yield k, n, loss, total.tobytes()

        if groups:
            wanted = [k * groups + g for k in fits for g in range(groups)]
            found = context.runJob(rows.mapPartitionsWithIndex(run_apart), iter, wanted)
        else:
            found = rows.mapPartitions(run).collect()
        n, loss, total = dict.fromkeys(fits, 0), dict.fromkeys(fits, 0.0), {k: np.zeros(len(x)) for k, x in points.items()}
        for _ in range(len(found)):  # each is let go as soon as it is added
            k, some, part, sums = found.pop(0)
            n[k], loss[k] = n[k] + some, loss[k] + part
            total[k] += np.frombuffer(sums, np.float32)
        shared.destroy()
        for k in fits:
            if not n[k]:
                raise ValueError("no training rows" if left_out[k] is None else f"no training rows without fold {left_out[k]}")
            total[k] /= n[k]
        return {k: (loss[k] / n[k], total[k]) for k in fits}

    return at


def _cell_counts(data: RDD[Block], flat: np.ndarray, sizes: Sequence[int], fold: int) -> np.ndarray:
    """Rows of one fold by [truth, prediction]."""
    shared, k = data.context.broadcast(flat.astype(np.float32)), sizes[-1]

    def run(parts: Iterator[Block]) -> Iterator[bytes]:
        cells = np.zeros((k, k), dtype=np.int64)
        layers = unflattened(shared.value, sizes)
        for _, y, *x in _laid_out(p for p in parts if p[0] == fold):
            np.add.at(cells, (y, _forward(_times(*x, layers[0][0]), layers)[1].argmax(axis=1)), 1)
        yield cells.tobytes()

    found = data.mapPartitions(run).collect()
    shared.destroy()
    return sum(np.frombuffer(c, np.int64) for c in found).reshape(k, k)


def held_out_f1(data: RDD[Block], flat: np.ndarray, sizes: Sequence[int], fold: int) -> float:
    """Support-weighted f1 on the rows of a fold."""
    cells = _cell_counts(data, flat, sizes, fold)
    if not cells.sum():
        raise ValueError(f"fold {fold} has no rows")
    both = cells.sum(axis=0) + cells.sum(axis=1)
    f1 = np.divide(2 * np.diag(cells), both, out=np.zeros(len(cells)), where=both > 0)
    return float((cells.sum(axis=1) * f1).sum() / cells.sum())


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision on one core: fits run side by side, and a BLAS would start threads for each."""
    return float(np.einsum("i,i", a, b, dtype=np.float64))


def _line(x: np.ndarray, f0: float, g0: np.ndarray, d: np.ndarray, step: float, most: int = 20) -> Generator[np.ndarray, At, tuple[np.ndarray, float, np.ndarray] | None]:
    """(point, loss, gradient) on the line from x along d by the strong Wolfe conditions; the best
    point that is lower if none does, None if none is.  Asks for points, is sent what is there; points
    are asked for in single precision and not kept meanwhile."""

    def place(step: float) -> np.ndarray:
        point = step * d
        point += x
        return point

    s0 = _dot(g0, d)
    if s0 >= 0:
        return None
    low, high, best = (0.0, f0, s0), None, None
    for _ in range(most):
        f, g = yield place(step).astype(np.float32)
        s = _dot(g, d)
        if np.isfinite(f) and f < f0 and (best is None or f < best[1]):
            best = (step, f, g)
        if not np.isfinite(f) or f > f0 + 1e-4 * step * s0 or (low[0] and f >= low[1]):
            high = (step, f, s)
        elif abs(s) <= -0.9 * s0:
            return place(step), f, g
        else:
            if s * ((high[0] if high else np.inf) - low[0]) >= 0:
                high = low
            low = (step, f, s)
        if high is None:
            step *= 1.5
            continue
        a, b = low[0], high[0]
        # The lowest place of the cubic through both ends, well inside them.
        with np.errstate(all="ignore"):
            d1 = low[2] + high[2] - 3 * (low[1] - high[1]) / (a - b)
            d2 = np.sign(b - a) * np.sqrt(d1 * d1 - low[2] * high[2])
            step = float(b - (b - a) * (high[2] + d2 - d1) / (high[2] - low[2] + 2 * d2))
        left, right = min(a, b), max(a, b)
        if not left + 0.1 * (right - left) <= step <= right - 0.1 * (right - left):
            step = (a + b) / 2
    return best and (place(best[0]), *best[1:])


def _set_aside(rows: int, width: int) -> np.ndarray:
    """Single precision zeros in a scratch file without a name, of which the system keeps in memory what it can."""
    with tempfile.TemporaryFile() as f:
        f.truncate(rows * width * 4)
        return np.frombuffer(mmap.mmap(f.fileno(), rows * width * 4), np.float32).reshape(rows, width)


def minimised(x: np.ndarray, max_iter: int, tol: float = 1e-6) -> Generator[np.ndarray, At, tuple[np.ndarray, list[float]]]:
    """(point, losses of the start and of every iteration); asks for points, is sent what is there.
    The corrections lie in a scratch file."""
    f, g = yield x
    history, pairs = [f], deque(maxlen=_CORRECTIONS)
    aside, made = _set_aside(2 * _CORRECTIONS, len(x)), 0
    while len(history) <= max_iter and _dot(g, g) ** 0.5 > max(tol * f, 1e-8):
        d, used, held = -g, [], np.empty_like(x)
        for s, y, rho in reversed(pairs):
            used.append(rho * _dot(s, d))
            d -= np.multiply(y, used[-1], out=held, dtype=np.float64)
        if pairs:
            s, y, rho = pairs[-1]
            d /= rho * _dot(y, y)
        for (s, y, rho), a in zip(pairs, reversed(used), strict=True):
            d += np.multiply(s, a - rho * _dot(y, d), out=held, dtype=np.float64)
        del held  # what is kept from step to step is kept for all fits at once
        found = yield from _line(x, f, g, d, 1.0 if pairs else 1 / _dot(g, g) ** 0.5)
        if found is None:
            if not pairs:
                break
            pairs.clear()  # once more from the gradient alone
            continue
        del d
        s, y = (np.subtract(a, b, out=np.empty(len(x), np.float32), casting="same_kind") for a, b in ((found[0], x), (found[2], g)))
        if (sy := _dot(s, y)) > 0:
            k = made % _CORRECTIONS  # that of the oldest, which leaves
            aside[2 * k], aside[2 * k + 1] = s, y
            pairs.append((aside[2 * k], aside[2 * k + 1], 1 / sy))
            made += 1
        del s, y
        x, f, g = found
        history.append(f)
        if max(history[-_FLAT:]) - f <= tol * history[0]:
            break
    return x, history


def at_once(n_weights: int) -> int:
    """Fits of so many weights that make their steps at once: of each, the driver holds its place, gradient,
    direction, next place and its gradient; the corrections lie in files."""
    return max(1, HELD // (n_weights * 5 * 8))


def fitted(losses: Losses, starts: Sequence[np.ndarray], max_iter: int, tol: float = 1e-6, most: int | None = None) -> list[tuple[np.ndarray, list[float]]]:
    """`minimised` from each start; the fits, `most` at a time, make their steps together, those that end leave."""
    n, ended = len(starts), {}
    turns = -(-n // (most or n))

    def next_point(job: tuple[int, At]) -> tuple[int, np.ndarray | None]:
        k, found = job
        try:
            return k, fits[k].send(found)
        except StopIteration as end:
            ended[k] = end.value
            return k, None

    with ThreadPoolExecutor(min(n, _HANDS)) as side_by_side:
        for turn in range(turns):
            fits = {k: minimised(starts[k], max_iter, tol) for k in range(turn * n // turns, (turn + 1) * n // turns)}
            points = {k: next(fit) for k, fit in fits.items()}
            while points:
                points = {k: x for k, x in side_by_side.map(next_point, losses(points).items()) if x is not None}
    return [ended[k] for k in range(n)]
