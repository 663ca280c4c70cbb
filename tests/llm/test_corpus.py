"""Line runs, SimHash groups, repeated strings and quality rules next to plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import lines, quality, simhash, suffixes
from opinara.llm.common import components

from . import brute


def documents(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 350))) for _ in range(20)]
    out = []
    for i in range(n):
        x, b = rng.random(), rng.choice(base)
        if x < 0.3:
            text = b
        elif x < 0.6:
            p = rng.randint(0, len(b))
            text = b[:p] + "X" * rng.randint(0, 250) + b[p:]
        elif x < 0.8:
            text = "".join(rng.choice(base) for _ in range(3))
        elif x < 0.9:
            text = "ab" * rng.randint(0, 300)
        else:
            text = None if x < 0.95 else "\0" * rng.randint(0, 250) + "q"
        out.append((i, text))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 300):
        for k in (1, 2, 3, 200):
            s = np.array([rng.randint(1, k) for _ in range(n)] + [0])
            if n == 300:
                s = np.append(np.tile(s[:60], 5), 0)
            sa = suffixes.suffix_array(s)
            plain = s.tolist()
            assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])  # noqa: B023
            got = suffixes.common_prefixes(s.astype(np.uint8), s, sa, 17)
            for i, j in zip(sa[1:], sa[:-1], strict=True):
                c = 0
                while c < 17 and max(i, j) + c < len(plain) and plain[i + c] == plain[j + c]:
                    c += 1
                assert got[i] == c


@pytest.mark.parametrize("hot", [suffixes.HOT, 4])
def test_repeated_strings(spark, hot):
    docs = documents(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept) for r in suffixes.dedup(df, with_text=False, hot=hot).collect()}
    want = {i: (*x[:3], brute.sha(x[3])) for i, x in brute.repeated_bytes(docs, 100).items()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_block_borders_lose_no_window():
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(2000))
    groups = list(suffixes._segment_batch([(0, 1, at, text.encode()[at : at + 150 + 99])], 100) for at in range(0, 1901, 150))
    covered = sorted((s, s + w) for g in groups for s, w in zip(g["start"].to_pylist(), g["windows"].to_pylist(), strict=True))
    assert covered[0][0] == 0 and covered[-1][1] == 1901
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_line_runs(spark, n):
    rng = random.Random(n)
    pool = ["a", "b", "c", "", "  ", "long line", "é"]
    docs = [(i, None if i % 17 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["_id"]: (r.n_lines, r.n_removed, r.n_runs, r.reach, r.kept) for r in lines.dedup(df, n).collect()}
    assert [got[i] for i, _ in docs] == brute.line_runs(docs, n)


def test_simhash_groups(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(df).collect()}
    want = {i: x for (i, _), x in zip(docs, brute.simhash_groups(docs), strict=True)}
    assert got == want


@pytest.mark.parametrize("tile", [simhash.TILE, 7])
def test_tiles_lose_no_link(spark, tile):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)} | {0, 3, 2**64 - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    found = simhash.links(df, 2, tile).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    got = {r.node: r.component for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    g = brute.Groups(len(signed))
    for a in range(len(signed)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                g.join(a, b)
    low = {}
    for k, x in enumerate(signed):
        low[g.find(k)] = min(low.get(g.find(k), x), x)
    assert {x: got.get(x, x) for x in signed} == {x: low[g.find(k)] for k, x in enumerate(signed)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100}


def test_quality_measures_and_policies(spark):
    rng = random.Random(9)
    words = ["a", "bb", "#c", "d|", "ée", "STOP"]
    texts = [None, "", " ", "x", *("".join(rng.choice(words) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    texts += ["one two three four five six seven eight nine ten " * 3, "fine words in a text that goes on without any trouble for the rules at all until it ends here now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    book = quality.judge(quality.ledger(df))
    rows = {r.doc_id: r for r in book.collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rows[len(texts) - 1].kept
    alone = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(book).collect()}
    for name, _ in quality.RULES:
        bits = [r.fail_bits & quality.mask("v2") for r in rows.values()]
        assert alone[name] == (sum(bool(b & quality.bit(name)) for b in bits), sum(b == quality.bit(name) for b in bits))


def test_edges(messy, empty):
    n = messy.count()
    assert suffixes.dedup(messy).count() == n and suffixes.dedup(empty).count() == 0
    assert lines.dedup(messy).count() == n and lines.dedup(empty).count() == 0
    assert simhash.report(messy).count() == n and simhash.report(empty).count() == 0
    assert quality.ledger(messy).count() == n and quality.ledger(empty).count() == 0
    for stage in (lines.cleaned, suffixes.cleaned):
        out = stage(messy.withColumn("n_chars", F.lit(0)))
        assert out.columns == [*messy.columns, "n_chars"] and out.count() == n
    kept = simhash.survivors(messy)
    assert kept.columns == messy.columns and simhash.survivors(empty).count() == 0
    # Groups: the short text, blank texts, the long text, the two texts met once.
    left = sorted(((r.doc_id or -1), (r.text or "")[:7]) for r in kept.collect())
    assert left == [(-1, "only he"), (1, "one two"), (2, ""), (5, "word wo"), (7, "another")]
    # Texts of one id and repeated rows: later copies lose what the first keeps.
    rest = {r.doc_id: r.n_removed for r in suffixes.dedup(messy).where("doc_id in (5, 6)").collect()}
    assert rest[5] > 0 and rest[6] == 150_000 + 200


def test_long_lines_and_equal_rows(spark):
    long, short = " ".join(f"w{i}" for i in range(lines.LONG)), "only a few words"
    texts = [long, f"a\n{long}\nb", short, short, f"x\n{short}", "\n".join("pqrstuv"), "\n".join("opqrstuvw"), "p\n\nq"]
    docs = list(enumerate(texts))
    got = {r["_id"]: (r.n_lines, r.n_removed, r.n_runs, r.reach, r.kept) for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == brute.line_runs(docs, 2)
    assert got[0][4] == long and got[1][4] == "a\nb" and got[6][3] == 4
    # Rows equal in id and text: one stays, the others are copies.
    rows = [(None, "one\ntwo\nthree")] * 40 + [(7, long)] * 3 + [(8, short)] * 3 + [(9, None)] * 2
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(r.kept) for r in out) == sorted(["one\ntwo\nthree", *[""] * 39, long, "", "", short, short, short, "", ""])
    assert {r.reach for r in out if r["_id"] is None} == {0, 2}
