"""Differences between sources next to plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinara.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least, top):
    """Sorted rows of (lang, source, text)."""
    counts, df = {}, {}
    for lang, source, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = TERM.findall(lower)
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        df.setdefault(lang or "", Counter()).update(set(words))
    out = []
    for lang, groups in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def chances(c):
            n = sum(c[t] for t in kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}  # noqa: B023

        q = chances(sum(groups.values(), Counter()))
        p = {s: chances(c) for s, c in groups.items()}
        for s, c in groups.items():
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if c[t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def corpus(n=400, sources=9):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("River", "stone", "é", "中文", "zz", "a", "Ab") for b in ("", "x", "ß", "\U0001f642", "Qq")]
    out = [(None, None, None), ("", "s1", "lone"), ("xx", "only", "a b c"), ("xx", None, ""), ("de", "empty", "1 2 3"), ("one", "s", "a a a"), ("one", "s", "a"), ("one", "s", "a-a_b")]
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 0, *range(sources)])}"
        k = rng.randint(0, 40)
        mine = rng.choices(words, [1 + (len(w) * 7 + ord(source[1])) % 5 for w in words], k=k)
        out.append((lang, source, rng.choice([" ", "\n", ", ", "1"]).join(mine)))
    return out


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, n long, term string").repartition(4)


def test_audit_equals_plain_python(spark):
    docs = corpus()
    df = frame(spark, docs)
    assert rows_of(divergence.audit(df)) == brute(docs, 3, 200)
    assert rows_of(divergence.audit(df, least=1, top=5)) == brute(docs, 1, 5)
    assert divergence.audit(df.limit(0)).collect() == []


def test_tiles_and_slices_give_the_same(spark):
    docs = corpus()
    terms, groups = divergence.prepared(frame(spark, docs))
    want = [r for r in brute(docs, 3, 200) if r[2] == "pair"]
    for tile, size in ((2, 10), (3, 10**6), (100, 7)):
        got = divergence.pairs(terms, groups, tile, size).withColumn("part", F.lit("pair"))
        assert rows_of(got) == want


@pytest.mark.parametrize("seed", range(3))
def test_skyband_keeps_what_can_lead(seed):
    rng = np.random.default_rng(seed)
    n, whole = rng.integers(1, 12, 900), rng.integers(1, 12, 900)
    terms = [b"%d" % k for k in rng.permutation(900)]
    for top in (1, 3, 20):
        over = np.array([sum((n >= n[k]) & (whole <= whole[k]) & np.array([t < terms[k] for t in terms])) for k in range(900)])
        assert sorted(divergence.skyband(n, whole, terms, top, block=64)) == np.flatnonzero(over < top).tolist()


def test_partial_skybands_and_counts_that_are_shipped_early(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(divergence, "_CHUNK", 7)
    counts = divergence._Counts()
    for lang, source, text in docs:
        counts.add((lang or "", source or ""), (text or "").encode())
    plain = {}
    for lang, source, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        plain.setdefault((lang or "", source or ""), Counter()).update(TERM.findall(lower))
    assert {g: {t.decode(): n for t, n in c[0].items()} for g, c in counts.groups.items()} == plain
    terms, _ = divergence.prepared(frame(spark, docs))
    schema = divergence._POINT
    points = terms.where("p > q").select(*[f.split()[0] for f in schema.split(", ")])
    narrow = points.mapInArrow(divergence._narrow(2, most=8), schema)
    want = [r for r in brute(docs, 3, 2) if r[2] == "term"]
    got = divergence.leading_terms(narrow.select("*"), 2).withColumn("part", F.lit("term"))
    assert rows_of(got) == want


def test_skyband_compares_no_crowds_of_like_terms(monkeypatch):
    """Terms alike in both counts leave before any comparison: 20,000 of them once met in blocks."""
    n, whole = np.ones(20_000, dtype=np.int64), np.full(20_000, 3)
    terms = [b"%05d" % k for k in range(20_000)][::-1]
    seen = []
    concatenate = np.concatenate
    monkeypatch.setattr(divergence.np, "concatenate", lambda parts, **k: seen.append(sum(map(len, parts))) or concatenate(parts, **k))
    assert sorted(divergence.skyband(n, whole, terms, 200)) == list(range(19_800, 20_000))
    assert sum(seen) < 2_000


def test_terms_are_counted_by_arrays_however_texts_are_held(monkeypatch):
    """Dictionaries of counts, a token at a time, took most of the counting's time."""
    rng = np.random.default_rng(5)
    words = ["a", "Bc", "bC", "é", "日本", "x1y", "--", ""]
    rows = [(str(rng.integers(2)), str(rng.integers(3)), " ".join(rng.choice(words, rng.integers(0, 30)))) for _ in range(200)]
    rows += [("0", "0", " "), ("1", "2", "Zz " * 500)]
    wanted: dict = {}
    for lang, source, text in rows:
        found = [t for part in divergence.terms_of(text.encode()) for t in part]
        for t in set(found):
            n = wanted.setdefault((lang, source, t.decode()), [0, 0])
            n[0], n[1] = n[0] + found.count(t), n[1] + 1
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(a, b, t.encode()) for a, b, t in rows], strict=True)], names=["lang", "source", "text"])
    for laid_out, held, chunk in ((12 << 20, 400_000, 1 << 22), (300, 400_000, 100), (300, 8, 1000), (1, 1, 50)):
        for name, value in (("_LAID_OUT", laid_out), ("_HELD", held), ("_CHUNK", chunk)):
            monkeypatch.setattr(divergence, name, value)
        got: dict = {}
        for part in divergence._count(iter([batch.slice(0, 90), batch.slice(90)])):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                x = got.setdefault((lang, source, term), [0, 0])
                x[0], x[1] = x[0] + n, x[1] + docs
        assert got == wanted
    assert list(divergence._count(iter([]))) == []


def test_skyband_compares_only_what_may_dominate(monkeypatch):
    """Of falling counts no term dominates another; each once met all that were kept before it."""
    n, terms = np.arange(5_000, 0, -1), [b"%05d" % k for k in range(5_000)]
    seen = []
    concatenate = np.concatenate
    monkeypatch.setattr(divergence.np, "concatenate", lambda parts, **k: seen.append(sum(map(len, parts))) or concatenate(parts, **k))
    assert sorted(divergence.skyband(n, n, terms, 200)) == list(range(5_000))
    assert sum(seen) < 70_000
