"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors are folded to one representative with its number of copies.
2. Each pass hashes every vector and sorts all vectors by that number; near vectors share long
   prefixes and come to stand close.  The number begins with the nearest of `CELLS` centres and
   goes on with `BITS` signs of random projections of the vector less the mean of its cell.
   Every vector is compared with the next `WINDOW` in order, by cosine in double precision.
   All passes are one range-partitioned sort by (pass, number), and windows go on across the
   borders of partitions.  Of a dense stretch a spanning forest of its links leaves a task.
3. The verified pairs of all passes are united to components.
4. A bounded window cannot hold a dense group.  So each component is then compared in full: its
   members are dealt into tiles, and every pair of tiles is one block product that adds to the
   members' counts of linked vectors.  Pairs are counted, never emitted.

Centres and means come from `SAMPLE` representatives at most, others for every pass: vectors may
crowd around several directions, and a mean taken over all of them would leave each crowd on
one side of most projections.  The sample also tells how many passes there are: partners at
the threshold are made up for its vectors, and a partner is met in a pass if cell and as many
bits agree as part its cell's share of the table into stretches of `WINDOW`.  Passes are added
until such partners are met with probability `RECALL` on average; they run in turns of `PASSES`.
The passes only have to connect a group; the counts inside it are then exact.  Cosines within
1e-12 of the threshold are summed anew, without rounding on the way, in passes and counts alike.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link
with nothing and are their own component, as are vectors of another length than all others'
partners; rows repeating an id are separate vectors of one component; a null id is linked but
never names a component (`component_id` is null if all its ids are); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import components, scratch
from opinara.llm.simhash import _Forest

COSINE = 0.95
PASSES = 16
RECALL = 0.98
BITS = 42
CELLS = 64
SAMPLE = 4096
WINDOW = 32
TILE = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number, 20240229]).standard_normal((dim, BITS))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, dim, vec): vec is the bytes of doubles, null where the vector links with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("_vector").to_pylist():
            if not v or any(c is None for c in v):
                out.append(None)
                continue
            x = np.array(v, dtype="<f8") + 0.0  # -0.0 equals 0.0
            out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        dims = pa.array([None if b is None else len(b) // 8 for b in out], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), dims, pa.array(out, pa.binary())], names=["_id", "dim", "vec"])


@dataclass(frozen=True)
class Plan:
    """Sampled unit vectors of each length, the expected number of vectors, and the passes."""

    sample: dict[int, np.ndarray]
    share: dict[int, float]  # vectors of a length for each sampled one
    passes: int = PASSES

    def cells(self, dim: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres of a pass, the mean of each cell, and its expected number of vectors."""
        known = self.sample.get(dim)
        if known is None:
            return np.zeros((1, dim)), np.zeros((1, dim)), np.zeros(1)
        rng = np.random.default_rng([dim, number, 7])
        centres = known[rng.permutation(len(known))[:CELLS]]
        cell = (known @ centres.T).argmax(axis=1)
        size = np.bincount(cell, minlength=len(centres))
        means = np.zeros_like(centres)
        np.add.at(means, cell, known)
        return centres, means / np.maximum(size, 1)[:, None], size * self.share[dim]

    def codes(self, x: np.ndarray, number: int) -> np.ndarray:
        """The numbers of unit vectors of one length."""
        centres, means, _ = self.cells(x.shape[1], number)
        cell = (x @ centres.T).argmax(axis=1)
        signs = (x - means[cell]) @ _planes(x.shape[1], number) >= 0
        return (cell.astype(np.int64) << BITS) | (signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)))

    def met(self, dim: int, number: int, window: int, cosine: float) -> np.ndarray:
        """Whether the sampled vectors meet a made-up partner at the threshold."""
        x = self.sample[dim]
        rng = np.random.default_rng([dim, number, 13])
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(axis=1, keepdims=True) * x
        other /= np.maximum(np.sqrt((other * other).sum(axis=1, keepdims=True)), 1e-300)
        y = cosine * x + np.sqrt(1 - cosine**2) * other
        a, b = self.codes(x, number), self.codes(y, number)
        share = self.cells(dim, number)[2][a >> BITS]
        bits = np.clip(np.floor(np.log2(np.maximum(share / window, 1.0))), 0, BITS).astype(np.int64)
        return (a >> (BITS - bits)) == (b >> (BITS - bits))


def planned(reps: DataFrame, window: int = WINDOW, cosine: float = COSINE) -> Plan:
    """Samples the representatives and sets the number of passes."""
    number = reps.count()
    rows = reps.select("dim", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    known: dict[int, list[bytes]] = {}
    for r in rows:
        known.setdefault(r.dim, []).append(r.vec)
    sample = {dim: _units(np.frombuffer(b"".join(vs), dtype="<f8").reshape(-1, dim)) for dim, vs in known.items()}
    plan = Plan(sample, dict.fromkeys(sample, number / max(len(rows), 1)))
    return replace(plan, passes=max([passes_for(plan, dim, window, cosine) for dim in sample], default=PASSES))


def passes_for(plan: Plan, dim: int, window: int = WINDOW, cosine: float = COSINE) -> int:
    """Passes after which a partner at the threshold is met with probability `RECALL` on average.

    Every vector's chance of a pass is told by 4 x `PASSES` of them, half a hit more where none hit.
    """
    tries = 4 * PASSES
    hits = sum(plan.met(dim, number, window, cosine).astype(float) for number in range(tries))
    misses = 1 - np.maximum(hits, 0.5) / tries
    number = PASSES
    while (1 - misses**number).mean() < RECALL:
        number += PASSES
    return number


def _hash(passes: range, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _units(_matrix(part.column("vec")))
                for number in passes:
                    code = plan.codes(x, number)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(code), number, dtype=np.int32)),
                            part.column("dim"),
                            pa.array(code),
                            part.column("rep"),
                            part.column("vec"),
                        ],
                        names=["pass", "dim", "code", "rep", "vec"],
                    )

    return run


def _surely(value: np.ndarray, x: Callable[[tuple], tuple[np.ndarray, np.ndarray]], cosine: float) -> np.ndarray:
    """Which cosines reach the threshold; `x` gives the two vectors of a place.

    Sums depend on their order in the last digits, so what is that near is summed exactly.
    """
    hit = value >= cosine
    for place in zip(*np.nonzero(np.abs(value - cosine) < 1e-12), strict=True):
        a, b = x(place)
        hit[place] = math.fsum(a * b) >= cosine
    return hit


def _neighbours(window: int, cosine: float):
    """Sorted rows: links within the window, and the rows at the partition's ends (side 0: its
    first, side 1: its last), whose windows go on in the neighbouring partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] | None = None
        first_left = window
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("pass", "dim", "code", "rep", "vec")), strict=True))
            if first_left:
                head = rows[:first_left]
                first_left -= len(head)
                yield _edge_rows(head, 0)
            rows = (held or []) + rows
            yield _pairs(rows, window, cosine, len(held or []))
            held = rows[-window:]
        if held:
            yield _edge_rows(held, 1)

    return run


_FOUND = "a long, b long, side int, pass int, dim int, code long, rep long, vec binary"


def _record(**columns) -> pa.RecordBatch:
    kinds = dict(a=pa.int64(), b=pa.int64(), side=pa.int32(), dim=pa.int32(), code=pa.int64(), rep=pa.int64(), vec=pa.binary())
    kinds["pass"] = pa.int32()
    n = max(len(v) for v in columns.values())
    names = ["a", "b", "side", "pass", "dim", "code", "rep", "vec"]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds[c]) for c in names], names=names)


def _edge_rows(rows: list[tuple], side: int) -> pa.RecordBatch:
    p, d, c, r, v = (list(x) for x in zip(*rows, strict=True))
    return _record(**{"pass": p}, side=[side] * len(rows), dim=d, code=c, rep=r, vec=v)


def _pairs(rows: list[tuple], window: int, cosine: float, old: int) -> pa.RecordBatch:
    """A forest of the links between rows at most `window` apart; pairs of the first `old` rows
    are known."""
    a, b = [], []
    groups = [(r[0], r[1]) for r in rows]
    cuts = [0, *[i for i in range(1, len(rows)) if groups[i] != groups[i - 1]], len(rows)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        reps = np.array([r[3] for r in rows[s:e]])
        x = _units(np.frombuffer(b"".join(r[4] for r in rows[s:e]), dtype="<f8").reshape(e - s, -1))
        forest = _Forest(e - s)
        for step in range(1, min(window, e - s - 1) + 1):
            value = np.einsum("ij,ij->i", x[:-step], x[step:])
            hit = np.flatnonzero(_surely(value, lambda k: (x[k[0]], x[k[0] + step]), cosine))  # noqa: B023
            hit = hit[hit + step + s >= old]
            hit = hit[forest.join(hit, hit + step)]
            a.append(reps[hit])
            b.append(reps[hit + step])
    if not a or not sum(map(len, a)):
        return _record(a=[], b=[])
    pair = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)]), axis=0), axis=1)
    return _record(a=pair[0].tolist(), b=pair[1].tolist())


def _across(window: int, cosine: float):
    """Rows from the borders of partitions, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("pass", "dim", "code", "rep", "vec")), strict=True))
            rows = held + rows
            if rows:
                yield _pairs(rows, window, cosine, len(held)).select(["a", "b"])
                held = rows[-window:]

    return run


def candidates(reps: DataFrame, passes: int | None = None, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """(a, b): verified links between representatives (rep, dim, vec)."""
    plan = planned(reps, window, cosine)
    passes = passes or plan.passes
    # Each turn is written, so that its sorted copies can go before the next.
    turns = [_turn(reps, range(a, min(a + PASSES, passes)), plan, window, cosine) for a in range(0, passes, PASSES)]
    return reduce(DataFrame.unionByName, turns).distinct()


def _turn(reps: DataFrame, passes: range, plan: Plan, window: int, cosine: float) -> DataFrame:
    hashed = reps.select("rep", "dim", "vec").mapInArrow(_hash(passes, plan), "pass int, dim int, code long, rep long, vec binary")
    order = ["pass", "dim", "code", "rep"]
    dealt = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch(dealt.mapInArrow(_neighbours(window, cosine), _FOUND))
    edges = found.where("side is not null").select("pass", "dim", "code", "rep", "vec").distinct()
    # Border rows: 2 x window per partition; one sorted stretch for each pass.
    edges = edges.repartition("pass").sortWithinPartitions(*order).mapInArrow(_across(window, cosine), "a long, b long")
    return scratch(found.where("a is not null").select("a", "b").unionByName(edges).distinct())


def _block(cosine: float):
    """Rows of one pair of tiles, its first tile (role 0) before the second (role 1): how many
    vectors each member links with in the other tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, own_reps, own_copies, got = None, [], [], [], None

        def close() -> pa.RecordBatch | None:
            if got is None:
                return None
            reps = np.concatenate(own_reps)
            keep = got > 0
            return pa.RecordBatch.from_arrays([pa.array(reps[keep]), pa.array(got[keep])], names=["rep", "n"])

        for batch in batches:
            keys, roles = batch.column("block").to_pylist(), np.asarray(batch.column("role"))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or roles[i] != roles[i - 1]], len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if keys[s] != at:
                    if (done := close()) is not None:
                        yield done
                    at, own, own_reps, own_copies, got = keys[s], [], [], [], None
                x = _units(_matrix(part.column("vec")))
                reps, copies = np.asarray(part.column("rep")), np.asarray(part.column("copies"))
                if roles[s] == 0:
                    own.append(x)
                    own_reps.append(reps)
                    own_copies.append(copies)
                    continue
                if not own:
                    continue
                mine, whose = np.concatenate(own), np.concatenate(own_reps)
                linked = _surely(mine @ x.T, lambda k: (mine[k[0]], x[k[1]]), cosine)  # noqa: B023
                linked &= whose[:, None] != reps[None, :]
                got = (np.zeros(len(mine), dtype=np.int64) if got is None else got) + linked @ copies
        if (done := close()) is not None:
            yield done

    return run


def counts(members: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(rep, n): linked vectors of other representatives in the same component, copies included.

    `members` has component, rep, dim, vec and copies.  A component of t tiles is t x t blocks.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    m = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiles = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    m = m.select("component", "dim", "rep", "vec", "copies", "own", tiles)
    block = lambda x, y: F.concat_ws("/", "component", x, y).alias("block")
    dealt = m.select(block("own", "other"), F.lit(0).alias("role"), "rep", "copies", "vec").unionByName(
        m.select(block("other", "own"), F.lit(1).alias("role"), "rep", "copies", "vec")
    )
    dealt = dealt.repartition("block").sortWithinPartitions("block", "role")
    return dealt.mapInArrow(_block(cosine), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    passes: int | None = None,
    window: int = WINDOW,
    tile: int = TILE,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    rows = scratch(rows.mapInArrow(_clean, "_id long, dim int, vec binary"))
    # Representatives are numbered, since ids may be null or repeat.
    reps = rows.where("vec is not null").groupBy("dim", "vec").agg(F.count("*").alias("copies"), F.min("_id").alias("low"))
    reps = scratch(reps.withColumn("rep", F.monotonically_increasing_id()))
    found = components(candidates(reps, passes, window, cosine)).select(F.col("node").alias("rep"), "component")
    members = reps.join(found, "rep")
    linked = counts(members, cosine, tile)
    named = reps.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").join(linked, "rep", "left")
    named = named.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.join(named, "vec", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("_id") == F.when(F.col("vec").isNull(), F.col("_id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )
