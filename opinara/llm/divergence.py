"""How the sources of a language differ in their words.

1. *Counts.* Tasks count the terms of whole texts by (lang, source) and ship partial counts, never
   occurrences.  Of a language the terms in at least `LEAST` of its documents are kept.
2. *Chances.* A group or language gives a kept term p = 1 + floor(10^9 (count + 1) / (N + V)); two such
   numbers differ by floor((p - q)^2 / q).  All of it is integer arithmetic.
3. *Pairs of sources.* Sources are dealt into tiles of `TILE`, terms into slices.  A task holds
   the terms of two tiles in one slice and adds up the differences of all their pairs at once.
   Terms that neither tile has are alike for a pair and are added as one product.
4. *Terms of a source.* The difference grows with the count in the group and falls with the
   count in the language.  A term is dominated by those with a count in the group no lower, a
   count in the language no higher and an earlier UTF-8 form: all of them come before it.  Each
   partition keeps, for every group, its skyband: the terms with fewer than `TOP` dominators; a
   term that leaves has `TOP` others before it wherever it is.  Skybands are merged in two steps
   and what is left is ranked exactly.

A term is a run of letters A-Z, a-z and characters beyond ASCII; only A-Z are lower-cased.

Defined results: null text, lang and source are empty; rows are documents, also where ids repeat;
a group without terms, or of a language that keeps none, has all its pairs (of value 0 in the
latter) and no terms; a language with one source has no pairs; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.common import scratch

LEAST = 3
TOP = 200
SCALE = 1_000_000_000
TILE = 64  # sources
SLICE = 200_000  # counts of kept terms that a task holds, about
_HELD = 400_000  # counts that a task holds before it ships them
_LAID_OUT = 12 << 20  # bytes of texts whose terms are counted at once
_CHUNK = 1 << 22  # bytes of a text cut into terms at once
_FANOUT = 16

# Letters become lower case, other ASCII characters blanks; bytes of longer characters stay.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text = text.translate(_FOLD)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + _CHUNK)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class _Counts:
    """Counts of terms and of documents by (lang, source), of texts of any length."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, group: tuple[str, str], text: bytes) -> None:
        n, docs = self.groups.setdefault(group, (Counter(), Counter()))
        seen: set[bytes] = set()
        for part in terms_of(text):
            n.update(part)
            seen.update(part)
        docs.update(seen)

    def size(self) -> int:
        return sum(len(n) for n, _ in self.groups.values())

    def ship(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in self.groups.items():
            if not n:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(n)),
                    pa.array([source] * len(n)),
                    pa.array(n, pa.binary()).cast(pa.string(), safe=False),
                    pa.array(n.values(), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        self.groups.clear()


class _Arrays:
    """The same of texts of up to `_CHUNK` bytes, many at once."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.texts: list[bytes] = []  # folded, not counted yet
        self.of: list[int] = []  # their groups
        self.bytes = 0
        self.parts: list[pa.Table] = []  # (group, term, n, docs)
        self.held = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        number = self.groups.setdefault(group, len(self.groups))
        self.texts.append(text.translate(_FOLD))
        self.of.append(number)
        self.bytes += len(text)
        if self.bytes >= _LAID_OUT:
            self.count()

    def _keep(self, group: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> None:
        if len(n):
            self.parts.append(pa.table({"group": group, "term": term, "n": n, "docs": docs}))
            self.held += len(n)

    def count(self) -> None:
        """The texts held become counts: one sort of (group, term, document) as one number."""
        words = pc.ascii_split_whitespace(pa.array(self.texts, pa.binary()).cast(pa.string(), safe=False))
        doc, flat = np.asarray(pc.list_parent_indices(words)), words.flatten()
        real = pc.not_equal(pc.binary_length(flat), 0)  # there are empty ones at the ends
        coded = flat.filter(real).dictionary_encode()
        doc, size, most = doc[np.asarray(real)], len(coded.dictionary), max(1, len(self.texts))
        key = (np.array(self.of, dtype=np.int64)[doc] * size + np.asarray(coded.indices)) * most + doc
        key.sort()
        pair = key // most
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        fresh = np.diff(key, prepend=-1) != 0
        if len(key):
            self._keep(pair[new] // size, coded.dictionary.take(pa.array(pair[new] % size)), np.diff(new, append=len(key)), np.add.reduceat(fresh.astype(np.int64), new))
        self.texts, self.of, self.bytes = [], [], 0

    def merge(self) -> None:
        if len(self.parts) > 1:
            whole = pa.concat_tables(self.parts).combine_chunks()
            coded = whole["term"].combine_chunks().dictionary_encode()
            key = whole["group"].to_numpy() * len(coded.dictionary) + np.asarray(coded.indices)
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            sums = [np.add.reduceat(whole[c].to_numpy()[order], new) for c in ("n", "docs")]
            at = key[order][new]
            self.parts, self.held = [], 0
            self._keep(at // len(coded.dictionary), coded.dictionary.take(pa.array(at % len(coded.dictionary))), *sums)

    def ship(self) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array(x, pa.string()) for x in zip(*self.groups, strict=True)) if self.groups else ([], [])
        for part in self.parts:
            for rows in part.to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([langs.take(rows["group"]), sources.take(rows["group"]), rows["term"], rows["n"], rows["docs"]], names=["lang", "source", "term", "n", "docs"])
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, long = _Arrays(), _Counts()
    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, value in zip(keys, batch.column("text"), strict=True):
            text = value.as_py()
            if len(text) > _CHUNK:
                long.add(group, text)
                if long.size() > _HELD:
                    yield from long.ship()
                continue
            counts.add(group, text)
            if counts.held > _HELD:
                counts.merge()
                if counts.held > _HELD // 2:
                    counts.count()  # the texts held refer to these groups
                    yield from counts.ship()
    counts.count()
    counts.merge()
    yield from counts.ship()
    yield from long.ship()


def _read(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).cast("binary").alias("text"))


def counted(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, source, n, whole, lead) of the kept terms; one row of a term leads.

    Partial counts meet once, dealt by language and term: a key has a row for each task and
    source at most, and both sums follow from that one exchange.
    """
    parts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    counts = counts.withColumn("whole", F.sum("n").over(term)).withColumn("d", F.sum("docs").over(term))
    counts = counts.withColumn("lead", F.col("source") == F.min("source").over(term))
    return counts.where(F.col("d") >= least).select("lang", "term", "source", "n", "whole", "lead")


def _chance(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)), exact also where the product leaves a long."""
    div = lambda a, b: F.call_function("div", a, b)
    wide = div(F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kept).cast("decimal(20,0)"))
    return F.when(n < 9 * SCALE, div(F.lit(SCALE) * (n + 1), total + kept)).otherwise(wide) + 1


def prepared(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, source, term, n, whole, p, q) and groups (lang, source, v, p0).

    `whole` is the term's count in the language, q its chance there, p0 the chance in the group
    of a term that it lacks.
    """
    read = _read(docs, lang_col, source_col, text_col)
    kept = scratch(counted(read, least))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    sizes = kept.where("lead").groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("total"))
    groups = read.select("lang", "source").distinct().join(sizes, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.fillna(0, ["v", "total", "own"])
    p0 = F.when(F.col("v") > 0, _chance(F.lit(0).cast("long"), F.col("own"), F.col("v")))
    groups = scratch(groups.withColumn("p0", p0))
    rows = kept.join(groups.select("lang", "source", "v", "total", "own"), ["lang", "source"])
    p, q = _chance(F.col("n"), F.col("own"), F.col("v")), _chance(F.col("whole"), F.col("total"), F.col("v"))
    return rows.select("lang", "source", "term", "n", "whole", p.alias("p"), q.alias("q")), groups


def skyband(n: np.ndarray, whole: np.ndarray, terms: list, top: int, block: int = 256) -> np.ndarray:
    """Places of the points with fewer than `top` dominators.

    Sorted by falling n, rising whole and rising term, dominators come before what they
    dominate; those within the skyband are enough to tell who leaves it.
    """
    place = np.empty(len(terms), dtype=np.int64)
    place[np.asarray(pc.array_sort_indices(pa.array(terms, pa.binary()))).astype(np.int64)] = np.arange(len(terms))
    order = np.lexsort((place, whole, -n))
    # Of terms alike in both counts only the first `top` have fewer dominators among themselves.
    alike = np.append(True, (np.diff(n[order]) != 0) | (np.diff(whole[order]) != 0))[: len(order)]
    first = np.flatnonzero(alike)
    order = order[np.arange(len(order)) - first[np.cumsum(alike) - 1] < top] if len(order) else order
    w, t = whole[order], place[order]
    kept = np.zeros(0, dtype=np.int64)
    for a in range(0, len(order), block):
        new = np.arange(a, min(a + block, len(order)))
        near = kept[(w[kept] <= w[new].max()) & (t[kept] < t[new].max())]  # others dominate none of these
        over = np.concatenate([near, new])
        above = (w[over][:, None] <= w[new][None, :]) & (t[over][:, None] < t[new][None, :]) & (over[:, None] < new[None, :])
        kept = np.concatenate([kept, new[above.sum(axis=0) < top]])
    return order[kept]


_POINT = "lang string, source string, term string, n long, whole long, p long, q long"


def _narrow(top: int, most: int = 200_000):
    """Keeps each group's skyband of the rows that a task sees; `most` bounds the rows it holds.

    Where the skybands of very many groups fill the buffer they are passed on and begun anew.
    """
    names = [f.split()[0] for f in _POINT.split(", ")]

    def least(rows: pa.Table) -> pa.Table:
        return rows.take(pa.array(skyband(rows["n"].to_numpy(), rows["whole"].to_numpy(), rows["term"].cast(pa.binary()).to_pylist(), top))).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[pa.Table]] = {}
        new = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for parts in held.values():
                yield from pa.concat_tables(parts).to_batches()
            held.clear()

        def settle() -> int:
            for group, parts in held.items():
                if len(parts) > 1 or parts[0].num_rows > top:
                    held[group] = [least(pa.concat_tables(parts))]
            return sum(parts[0].num_rows for parts in held.values())

        for batch in batches:
            rows = pa.Table.from_batches([batch.select(names)])
            places: dict[tuple[str, str], list[int]] = {}
            for k, key in enumerate(zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), strict=True)):
                places.setdefault(key, []).append(k)
            for key, at in places.items():
                held.setdefault(key, []).append(rows.take(pa.array(at)))
            new += rows.num_rows
            if new >= most:
                new = 0
                if settle() >= most // 2:
                    yield from passed_on()
        settle()
        yield from passed_on()

    return run


def leading_terms(terms: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the `top` terms that a group has more often than its
    language, by difference."""
    points = terms.where("p > q").select(*[f.split()[0] for f in _POINT.split(", ")])
    points = points.mapInArrow(_narrow(top), _POINT)
    # Two steps of merging: a task of the first sees a part of a group's partitions' skybands.
    salt = F.pmod(F.xxhash64("term"), F.lit(_FANOUT))
    points = points.repartition("lang", "source", salt).mapInArrow(_narrow(top), _POINT)
    points = points.repartition("lang", "source").mapInArrow(_narrow(top), _POINT)
    value = _difference("p", "q")
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = points.select("lang", "source", F.col("term").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top)


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Differences of all pairs (a of the first tile, b of the second) over the terms that one of them has."""
    lang, i, j = (k.as_py() for k in key[:3])
    side, source = table["side"].to_numpy(), np.array(table["source"].to_pylist(), dtype=object)
    term, p = table["term"], table["p"].to_numpy()
    head = table["head"].to_numpy(zero_copy_only=False)
    tiles, base = [], []
    for s in (0, 1):
        mine = np.flatnonzero(head & (side == s))
        mine = mine[np.argsort(source[mine])]
        tiles.append(source[mine])
        base.append(p[mine])
    body = np.flatnonzero(~head)
    code = term.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[body] if len(body) else np.zeros(0, dtype=np.int64)
    names, code = np.unique(code, return_inverse=True)
    total = np.zeros((len(tiles[0]), len(tiles[1])), dtype=np.int64)
    place = [{name: k for k, name in enumerate(t)} for t in tiles]
    column = np.array([place[s][name] for s, name in zip(side[body].tolist(), source[body].tolist(), strict=True)], dtype=np.int64)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(0, len(names) + 4096, 4096))
    for a, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rows = order[x:y]
        if not len(rows):
            continue
        size = min(4096, len(names) - a * 4096)
        both = []
        for s in (0, 1):
            dense = np.repeat(base[s][:, None], size, axis=1)
            own = rows[side[body][rows] == s]
            dense[column[own], code[own] - a * 4096] = p[body][own]
            both.append(dense)
        for b in range(len(tiles[1])):
            q = both[1][b][None, :]
            total[:, b] += ((both[0] - q) ** 2 // q).sum(axis=1)
    a, b = np.meshgrid(np.arange(len(tiles[0])), np.arange(len(tiles[1])), indexing="ij")
    a, b = a.ravel(), b.ravel()
    return pa.table(
        {
            "lang": pa.array([lang] * len(a), pa.string()),
            "source": pa.array(tiles[0][a].tolist(), pa.string()),
            "item": pa.array(tiles[1][b].tolist(), pa.string()),
            "value": pa.array(total.ravel()),
            "seen": pa.array(np.full(len(a), len(names), dtype=np.int64)),
        }
    )


def pairs(terms: DataFrame, groups: DataFrame, tile: int = TILE, size: int = SLICE) -> DataFrame:
    """(lang, source, item, value, rank): how a source differs from each other one of its language."""
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    dealt = groups.withColumn("tile", F.floor(number / tile).cast("int"))
    tiles = W.partitionBy("lang")
    rows = terms.groupBy("lang").agg(F.count("*").alias("rows"))
    # A block of two tiles has about this share of the language's counts.
    dealt = dealt.withColumn("tiles", F.max("tile").over(tiles) + 1).join(rows, "lang", "left")
    slices = F.ceil(F.coalesce("rows", F.lit(0)) * 2 / (F.col("tiles") * F.lit(size)))
    dealt = scratch(dealt.select("lang", "source", "v", F.coalesce("p0", F.lit(1)).alias("p0"), "tile", "tiles", F.greatest(F.lit(1), slices).cast("int").alias("slices")))
    place = dealt.select("lang", "source", "tile", "tiles", "slices")
    slot = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    body = terms.join(place, ["lang", "source"]).select("lang", "source", "term", "p", "tile", "tiles", slot, F.lit(False).alias("head"))
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    head = dealt.select("lang", "source", F.lit("").alias("term"), F.col("p0").alias("p"), "tile", "tiles", every, F.lit(True).alias("head"))
    both = body.unionByName(head).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("tile").alias("i"), F.col("other").alias("j")), F.struct(F.lit(1).alias("side"), F.col("other").alias("i"), F.col("tile").alias("j"))))
    both = both.withColumn("at", sides).select("lang", "at.i", "at.j", "slice", "at.side", "source", "term", "p", "head")
    sums = both.groupBy("lang", "i", "j", "slice").applyInArrow(_pair_sums, "lang string, source string, item string, value long, seen long")
    sums = sums.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    a = dealt.select("lang", "source", "v", F.col("p0").alias("p"))
    b = dealt.select("lang", F.col("source").alias("item"), F.col("p0").alias("q"))
    sums = sums.join(a, ["lang", "source"]).join(b, ["lang", "item"])
    value = F.col("value") + (F.col("v") - F.col("seen")) * _difference("p", "q")
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return sums.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    terms, groups = prepared(docs, least)
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for name, x in (("pair", pairs(terms, groups)), ("term", leading_terms(terms, top)))]
    return parts[0].unionByName(parts[1])


def oracle(least: int = LEAST, top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chance = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({total} + v))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
whole AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= {least}),
sizes AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM whole GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN whole USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS own FROM n GROUP BY ALL),
full_rows AS (SELECT g.lang, g.source, w.term, w.whole, s.v, s.total, coalesce(o.own, 0) AS own, coalesce(n.n, 0) AS n
  FROM g JOIN whole w USING (lang) JOIN sizes s USING (lang) LEFT JOIN own o USING (lang, source) LEFT JOIN n USING (lang, source, term)),
c AS (SELECT lang, source, term, n, {chance('n', 'own')} AS p, {chance('whole', 'total')} AS q FROM full_rows),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM c WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
