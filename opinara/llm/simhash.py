"""SimHash near-duplicates by tiled exact comparison of fingerprints.

1. *Fingerprints.* ASCII letters are lower-cased, words are maximal runs of non-blank bytes,
   shingles are `SHINGLE` words joined by blanks (repeats count; fewer words: the whole
   sequence).  A bit is set if it is set in over half of the shingles' XXH64 values (seed 42).
2. *Tiles.* Different fingerprints are dealt into cells by the bit counts of their four 16-bit
   parts.  Fingerprints within `radius` bits differ by at most `radius` in the sum over parts
   of these counts, so only cells that near are compared; all other tile pairs are skipped.
   Crowded cells are split into tiles of about `TILE` fingerprints.
3. *Comparison.* A task holds one tile and streams the fingerprints of nearby cells past it in
   blocks: exclusive-or, bit count, threshold.  It returns a spanning forest of the links,
   never all pairs, so a dense group costs as many rows as it has fingerprints.
4. *Groups.* Connected components over the forests; copies share their fingerprint's group.

Defined results: null and blank texts have fingerprint zero and are linked like any other;
rows with one id are separate rows of the result; null ids are linked but never name a group
(a group of null ids only has a null component); an empty table gives no rows; other columns
are ignored by `groups` and kept by `survivors`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.common import components, packed, scratch, unpacked

SHINGLE = 3
RADIUS = 2
TILE = 4096
_PARTS = 4
_LANES = np.uint64(0x0101010101010101)


def _hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(joined, 42)]
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(stops[:-shingle] + 1).tolist()]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops[shingle - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Majority bits per document; every document has at least one hash.

    Bits are counted in eight byte-wide lanes per word, over at most 255 hashes at a time.
    """
    first = np.cumsum(lengths) - lengths
    blocks = -(-lengths // 255)
    block_first = np.cumsum(blocks) - blocks
    starts = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(block_first, blocks))
    out = np.zeros(len(lengths), dtype=np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), block_first)
        for byte in range(8):
            out |= (2 * counts[:, byte] > lengths).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """The 64-bit fingerprint of each text; works through at most about a million hashes at once."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held, rows, size = [], [], 0
    for i, text in enumerate(texts):
        hashes = _hashes(text)
        if hashes:
            held.append(np.array(hashes, dtype=np.uint64))
            rows.append(i)
            size += len(hashes)
        if size >= 1_000_000 or (i == len(texts) - 1 and rows):
            out[rows] = _majority(np.concatenate(held), np.array([len(h) for h in held]))
            held, rows, size = [], [], 0
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = fingerprints_of(batch.column("_text").to_pylist())
        columns = [batch.column("_id"), batch.column("_content"), pa.array(bits.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "_content", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _content, fp): a hash of the text, and the fingerprint as a signed long."""
    text = F.col(text_col).alias("_text")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_content"), text)
    return rows.mapInArrow(_fingerprint, "_id long, _content long, fp long")


def _cell(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))).alias(f"c{i}") for i in range(_PARTS)]


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Cells at a distance of 1 to `radius`, one of each opposite pair."""
    ball = product(range(-radius, radius + 1), repeat=_PARTS)
    return [s for s in ball if 0 < sum(map(abs, s)) <= radius and s > (0,) * _PARTS]


class _Forest:
    """Groups of a tile's fingerprints, as an array of roots."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Links the pairs; returns the numbers of those that joined two groups."""
        pair = np.flatnonzero(self.root[a] != self.root[b])
        joined = [pair[:0]]
        while len(pair):
            ra, rb = self.root[a[pair]], self.root[b[pair]]
            # Each group is hung once, under a smaller one; what is still apart goes again.
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, pick = np.unique(high, return_index=True)
            target = np.arange(len(self.root))
            target[high[pick]] = low[pick]
            while (target[target] != target).any():
                target = target[target]
            self.root = target[self.root]
            joined.append(pair[pick])
            pair = pair[self.root[a[pair]] != self.root[b[pair]]]
        return np.concatenate(joined)


def _compare(radius: int, block: int = 512):
    """Rows sorted by (tile, role): role 0 is the tile itself, role 1 what is compared with it."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[:, None] ^ y[None, :]) <= radius

    def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        own: list[np.ndarray] = []
        tile, forest = np.zeros(0, dtype=np.uint64), _Forest(0)
        ready = False
        out: list[tuple[int, int]] = []

        def add(x: np.ndarray, y: np.ndarray) -> None:
            out.extend(zip(x.view(np.int64).tolist(), y.view(np.int64).tolist(), strict=True))

        def settle() -> None:
            """Compares the tile with itself once it is complete."""
            nonlocal tile, forest, ready
            tile, ready = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64), True
            forest = _Forest(len(tile))
            for a in range(0, len(tile), block):
                i, j = np.nonzero(near(tile[a : a + block], tile[: a + block]))
                new = forest.join(i + a, j)
                add(tile[i[new] + a], tile[j[new]])

        def stream(others: np.ndarray) -> None:
            for a in range(0, len(others), block):
                part = others[a : a + block]
                hit = near(tile, part)
                met, first = hit.any(axis=0), hit.argmax(axis=0)
                add(tile[first[met]], part[met])
                i, j = np.nonzero(hit)
                new = forest.join(i, first[j])
                add(tile[i[new]], part[j[new]])

        for batch in batches:
            keys, roles = np.asarray(batch.column("tile")), np.asarray(batch.column("role"))
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1
            for part in np.split(np.arange(len(keys)), cuts):
                if not len(part):
                    continue
                if keys[part[0]] != at:
                    if not ready and own:
                        settle()
                    at, own, ready = keys[part[0]], [], False
                if roles[part[0]] == 0:
                    own.append(fps[part])
                else:
                    if not ready:
                        settle()
                    if len(tile):
                        stream(fps[part])
                if len(out) >= 10_000:
                    yield links(out)
                    out = []
        if not ready and own:
            settle()
        if out:
            yield links(out)

    return run


def _tile_key(number: str) -> Column:
    """A long of the cell's counts and the tile number within the cell."""
    cell = F.col("c0")
    for i in range(1, _PARTS):
        cell = cell * 17 + F.col(f"c{i}")
    return F.shiftleft(cell.cast("long"), 32) + F.col(number)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest of the links between the different fingerprints `fp`."""
    cells = [f"c{i}" for i in range(_PARTS)]
    rows = fps.select("fp", *_cell(F.col("fp")))
    # At most 17^4 = 83,521 cells exist, whatever the number of documents: a bounded broadcast.
    sizes = rows.groupBy(*cells).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    rows = rows.join(F.broadcast(sizes), cells).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(s)]) for s in _steps(radius)])
    moved = rows.select("fp", *cells, F.explode(steps).alias("d")).select(
        "fp", *[(F.col(c) + F.col("d")[f"d{i}"]).alias(c) for i, c in enumerate(cells)]
    )
    others = moved.join(F.broadcast(sizes), cells).select("fp", *cells, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    same_cell = rows.where("own > 0").select("fp", *cells, F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("t"))
    dealt = (
        rows.select("fp", _tile_key("own").alias("tile"), F.lit(0).alias("role"))
        .unionByName(others.unionByName(same_cell).select("fp", _tile_key("t").alias("tile"), F.lit(1).alias("role")))
        .repartition("tile")
        .sortWithinPartitions("tile", "role")
    )
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(id, _content, fp, component_id), one row per input row."""
    fps = scratch(fingerprints(docs, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min("_id").alias("low"))
    named = components(links(distinct, radius, tile)).withColumnRenamed("node", "fp")
    named = distinct.join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = named.join(lows, "component").select("fp", "component_id")
    # A fingerprint that very many rows share is one row here: Spark splits the rows' side.
    return fps.join(by_fp, "fp").select(F.col("_id").alias(id_col), "_content", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id)."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` with one row left of each group: that of its smallest id.

    Of several texts of that id the first by hash stays.  A row with a null id comes after all
    others and stays if its group has no other.
    """
    last = F.lit(2**63 - 1) - F.pmod(F.xxhash64("_text"), F.lit(1 << 40))
    rows = packed(docs, "doc_id", "text").withColumn("_doc_id", F.coalesce(F.col("_doc_id").cast("long"), last))
    lead = groups(rows, radius, "_doc_id", "_text").where("_doc_id = component_id")
    lead = lead.groupBy("_doc_id", "component_id").agg(F.min("_content").alias("_content"))
    rows = rows.select("_row", "_doc_id", F.xxhash64("_text").alias("_content"))
    rows = rows.join(lead.select("_doc_id", "_content"), ["_doc_id", "_content"], "left_semi")
    order = W.partitionBy("_doc_id", "_content").orderBy(F.xxhash64("_row"))
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return unpacked(rows, docs.columns)
