"""The whole pipeline on odd tables, and the gradients of its classifier."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from opinara.llm import toxicity


def _folder(docs, tmp_path, labels):
    rows = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_on_odd_rows(spark, messy, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = corpus_pipeline.run(spark, _folder(messy, tmp_path, labels)).collect()
    # Without toxic training rows nothing goes in the first stage; copies go, one of each stays.
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    assert set(sizes) == {1, 5, 7, None}
    assert sizes[1] == len("one two three four five six seven eight nine ten")
    assert all(0 < r.n_tokens <= r.bucket_len for r in rows)


def test_run_on_an_empty_table(spark, messy, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0)
    assert corpus_pipeline.run(spark, _folder(messy.limit(0), tmp_path, labels)).collect() == []


def test_gradients_equal_finite_differences():
    texts = ["bad grub one", "fine river stone light", "grub", "river fine bad"]
    y = np.array([1.0, 0, 1, 0])
    net = toxicity.train(texts * 3, [1, 0, 1, 0] * 3)
    net.word, net.char = net.word.astype(float), net.char.astype(float)
    windows = [t.split() for t in texts]

    def loss():
        net._known.clear()
        net._rows.clear()
        flat = [w for ws in windows for w in ws]
        rows = net.inputs(flat)[1]
        at, mask, k = np.zeros((4, toxicity.WINDOW), int), np.zeros((4, toxicity.WINDOW), bool), 0
        for i, ws in enumerate(windows):
            at[i, : len(ws)], mask[i, : len(ws)] = range(k, k + len(ws)), True
            k += len(ws)
        z = np.asarray(net.windows(rows.astype(np.float32), at, mask), dtype=float)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))) + 0.5e-4 * float((net.out**2).sum())

    before = {n: np.array(getattr(net, n), dtype=float, copy=True) for n in ("w", "u", "b", "att", "key", "out", "word")}
    moments = {}
    bias, char = net.bias, net.char.copy()
    toxicity._step(net, windows, y, moments, 1)
    grads = {n: moments[n][0] / 0.1 for n in before}
    for n, v in before.items():
        setattr(net, n, v.copy())
    net.bias, net.char = bias, char
    rng = np.random.default_rng(0)
    checked = 0
    for n, g in grads.items():
        flat = np.argsort(-np.abs(g).ravel())[:4].tolist() + rng.integers(0, g.size, 2).tolist()
        for k in flat:
            place = np.unravel_index(k, g.shape)
            sides = []
            for step in (2e-2, -2e-2):
                value = before[n].copy()
                value[place] += step
                setattr(net, n, value)
                sides.append(loss())
            setattr(net, n, before[n].copy())
            numeric = (sides[0] - sides[1]) / 4e-2
            assert abs(numeric - g[place]) <= 0.05 * np.abs(g).max() + 1e-3, (n, place, numeric, g[place])
            checked += 1
    assert checked == 42
