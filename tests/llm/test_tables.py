"""Packing, sharding, token counts, pieces, vectors, toxicity and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opinara.llm import lines, packing, pieces, sharding, simhash, suffixes, tokens, toxicity, vectors

from . import brute


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(25):
        lengths = rng.sample(range(1, 60), rng.randint(1, 9))
        counts = [rng.randint(1, 20) for _ in lengths]

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))  # noqa: B023

        for k in (1, 2, 3, 20):
            got = packing.boundaries(lengths, counts, k)
            assert max(got) == max(lengths) and len(got) <= k
            best = min(
                padding([*c, max(lengths)])
                for size in range(min(k, len(lengths)))
                for c in itertools.combinations(sorted(lengths)[:-1], size)
            )
            assert padding(got) == best
    assert packing.boundaries([], [], 3) == []


def test_packing_places_every_byte_once(spark, messy, empty):
    docs = spark.createDataFrame([(i, "é" * (i * 7 % 90)) for i in range(300)] + [(None, "x" * 500)], "doc_id long, text string")
    rows = packing.pack(docs, context=100, buckets=4, budget=400).collect()
    size = {}
    for r in rows:
        assert 0 < r.n_tokens <= r.bucket_len <= 100 and r.padding == r.bucket_len - r.n_tokens
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {r.doc_id: len(r.text.encode()) for r in docs.collect() if r.text}
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket_len, r.batch), []).append(r.place)
    for (end, _), places in batches.items():
        assert sorted(places) == list(range(len(places))) and len(places) * end <= 400
    short = [k for k, p in batches.items() if len(p) < 400 // k[0]]
    assert len(short) == len({end for end, _ in short})  # one open batch per bucket
    total = sum(len((r.text or "").encode()) for r in messy.collect())
    assert packing.pack(messy).agg(F.sum("n_tokens")).first()[0] == total
    assert packing.pack(empty).count() == 0


def test_lookup_is_even_and_moves_little():
    names = sharding.shard_names(13)
    full = sharding.lookup(names, 4099)
    share = np.bincount(full, minlength=13)
    assert share.max() - share.min() <= 1
    fewer = sharding.lookup(names[:-1], 4099)
    moved = (fewer != full)[full != 12].mean()
    assert moved < 0.1
    weighted = np.bincount(sharding.lookup(["a", "b"], 101, [3, 1]))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4
    for bad in (lambda: sharding.lookup(names, 4100), lambda: sharding.lookup(["a", "a"], 101), lambda: sharding.lookup([], 101)):
        with pytest.raises(ValueError):
            bad()


def test_placement(messy, empty):
    rows = sharding.place(messy, sharding.shard_names(5), slots=101).collect()
    assert len(rows) == messy.count() and len({r.shard for r in rows if r.doc_id is None}) == 1
    whole = sharding.assign(messy, sharding.shard_names(5), slots=101)
    assert whole.count() == len(rows) and whole.select("row.*").columns == messy.columns
    assert sharding.place(empty, ["only"], slots=101).count() == 0


def test_token_histogram(messy, empty):
    e = tokens.encoder(tokens.VOCABULARY)
    lengths = [len(e.encode_ordinary(r.text)) if r.text else 0 for r in messy.collect()]
    sums = tokens.suffix_sums(tokens.histogram(messy)).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for limit in (0, 1, 5, 12, 10**9):
        assert tokens.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    assert tokens.quantile(sums, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert tokens.suffix_sums(tokens.histogram(empty)).count() == 0


def test_pieces_equal_the_library_and_round_trip(messy, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model, rng = pieces.load(), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "▁", "<0x0A>", "12", "\U0001f642", "ing", "tion", "aaaa", "=="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts += [c * n for c in ("a", "=", " ", "é", "ab") for n in (1, 31, 33, 500)]
    for t in texts:
        ids = pieces.encode_batch(pieces.Known(model), [t])[0].tolist()
        assert ids == library.encode(t)
        assert model.decode(ids) == t.replace("▁", " ")
    encoded = pieces.encode(messy)
    rows = encoded.collect()
    assert len(rows) == messy.count() and all(r.round_trip for r in rows)
    assert {r.n_ids for r in rows if r.doc_id in (2, 3)} == {0}
    back = sorted(r.text for r in pieces.decode(encoded).collect())
    assert back == sorted(r.text or "" for r in messy.collect())
    assert pieces.encode(empty).count() == 0


def test_unigram_paths_have_the_best_value():
    names = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "ca"]
    scores = [0.0, -2.0, -2.5, -2.2, -3.0, -3.9, -6.5, -3.1]
    model = pieces.Model(names, scores, [2] + [1] * 7, bpe=False, prefix=False)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        best = [0.0] + [-1e9] * len(text)
        for i in range(1, len(text) + 1):
            for p, s in zip(names[1:], scores[1:], strict=True):
                if text[:i].endswith(p):
                    best[i] = max(best[i], best[i - len(p)] + s)
        got = list(model.stream(text))
        assert "".join(p for _, p in got) == text
        assert abs(sum(scores[k] for k, _ in got) - best[-1]) < 1e-9


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 16))
    x = np.array([base[i % 6] + rng.standard_normal(16) * (0.15 if i % 3 else 0) for i in range(180)])
    odd = [(300, None), (301, []), (302, [0.0] * 16), (303, [None] * 16), (304, [float("nan")] * 16), (305, [1.0, 2.0]), (306, [1.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([*enumerate(x.tolist()), *odd], "vec_id long, embedding array<double>").repartition(3)
    rows = vectors.near_duplicates(df.withColumn("rep", F.lit(1)), tile=7).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    for i, (n, low) in enumerate(brute.vector_links(x)):
        assert got[i] == (n, low, i == low)
    assert [got[i] for i in range(300, 305)] == [(0, i, True) for i in range(300, 305)]
    assert got[305] == (2, 305, True) and got[306] == (2, 305, False) and got[None] == (2, 305, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_the_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 250")
    noisy = df.withColumn("vec_id", F.col("vec_id") + 1000).withColumn("embedding", F.transform("embedding", lambda v, i: v + F.when(i == 3, 0.05).otherwise(0.0)))
    both = df.select("vec_id", "embedding").unionByName(noisy.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")))
    rows = sorted((r.vec_id, r.embedding) for r in both.collect())
    want = brute.vector_links(np.array([v for _, v in rows], dtype=float))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(both).collect()}
    found = sum(got[i][0] for i, _ in rows)
    assert found >= 0.99 * sum(n for n, _ in want) > 0
    assert all(got[i][0] <= n for (i, _), (n, _) in zip(rows, want, strict=True))


def toxic_corpus(n=240):
    rng = random.Random(8)
    common = ["river", "stone", "light", "garden", "paper", "winter", "table", "music"]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(3, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["grubby", "grubbish", "snarkle", "grubbed"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_learns_and_holds_out(spark, messy, empty):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    tested = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in tested]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    # Unseen word with known letters, late in a long text.
    late = "river " * 3000 + "grubbier"
    a, b = net.scores([late, "river " * 3000])
    assert a > b
    assert toxicity.score(messy, net).count() == messy.count() and toxicity.score(empty, net).count() == 0
    assert toxicity.accepted(messy, net).columns == messy.columns
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none is None and toxicity.score(docs, none).agg(F.max("score")).first()[0] == 0.0


def test_gradients():
    rng = np.random.default_rng(3)
    texts = ["bad grub one", "fine river stone light", "grub", "river"]
    net = toxicity.train(texts * 3, [1, 0, 1, 0] * 3)
    windows = [t.split() for t in texts]
    y = np.array([1.0, 0, 1, 0])

    def loss():
        flat = [w for ws in windows for w in ws]
        rows = net.inputs(flat)[1]
        at, mask, k = np.zeros((4, 32), int), np.zeros((4, 32), bool), 0
        for i, ws in enumerate(windows):
            at[i, : len(ws)], mask[i, : len(ws)] = range(k, k + len(ws)), True
            k += len(ws)
        z = net.windows(rows.astype(np.float32), at, mask)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    before = loss()
    moments = {}
    for t in range(1, 15):
        toxicity._step(net, windows, y, moments, t)
    assert loss() < before
    del rng


def test_pipeline_stages_match_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit(1))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    have = {r.doc_id: r.text for r in docs.collect()}
    net = toxicity.fit(docs, labels)
    ids = sorted(have)
    ok = dict(zip(ids, net.scores([have[i] for i in ids]) < toxicity.THRESHOLD, strict=True))
    want = [{i: t for i, t in have.items() if ok[i]}]
    kept = sorted(want[0].items())
    want.append({i: x[4] for (i, _), x in zip(kept, brute.line_runs(kept, lines.MIN_LINES), strict=True)})
    groups = zip(want[1].items(), brute.simhash_groups(list(want[1].items())), strict=True)
    want.append({i: t for (i, t), (_, low) in groups if i == low})
    want.append({i: x[3].decode(errors="ignore") for i, x in brute.repeated_bytes(want[2].items(), suffixes.LENGTH).items()})
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want, strict=False):
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns, name
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
        if name != "toxicity":
            assert docs.where("n_chars <> char_length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(t.encode()) for t in want[-1].values())
    assert simhash.RADIUS == 2
