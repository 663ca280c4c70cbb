"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters the network as two vectors: a word embedding (words met in training) and a
character vector, the maximum over embeddings of its hashed byte n-grams, which also covers
unseen words.  A forward and a backward gated recurrent unit read windows of `WINDOW` words,
attention pools their states, and a logistic unit scores the window.  A text is scored over
all windows, each overlapping the next by half; its score is that of its worst window.

Training is plain numpy on the driver, over a bounded sample of labelled rows (`MAX_TOXIC`,
`MAX_CLEAN`, texts up to `MAX_CHARS` characters), never on held-out rows (crc32 of the id's
text mod 3 is 1).  Embeddings start from how strongly a word or n-gram goes with the label;
all weights are then fitted in `STEPS` steps of `BATCH` rows, whatever the number of rows, on the
worst window of each text and a random one of clean texts; worst windows are sought anew after
a quarter and three quarters of the steps.  Labels, ids, sources and languages are no inputs of a score.

The fitted model has a fixed size (about 3 MB) and is broadcast; scoring reads each text once,
without a shuffle.

Defined results: null and empty texts score like a text without words; without toxic or
without clean training rows every score is 0; several labels of one id count as toxic if one
is; of several texts of one id the first in order teaches; an id whose texts are all over
`MAX_CHARS` teaches nothing, though it was chosen; of windows that tie the first teaches; null
labels and null ids teach nothing; repeated rows get equal scores; an empty table gives no rows;
extra columns are ignored by `score` and kept by `accepted`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import packed, unpacked

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
VOCABULARY, NGRAMS = 20_000, 1 << 15
SIZES = (3, 4, 5, 6)
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 2000, 50_000
STEPS, BATCH = 300, 64
RATES = {"word": 0.0005, "char": 0.0005}  # embeddings move slowly: they could learn rows by heart
THRESHOLD = 0.7
CACHE = 120_000
GROUP = 100_000  # words scored together
CHUNK = 5_000  # words whose n-grams are laid out at once
_EDGE = ".,;:!?()[]\"'"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of '<word>' for all words at once: (first item of each word, items)."""
    data = [b"<" + w.strip(_EDGE).encode() + b">" for w in words]
    size = np.array([len(d) for d in data], dtype=np.int64)
    one = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(size, size) - (np.arange(len(one)) - np.repeat(start, size))  # bytes to the word's end
    owners, items = [np.arange(len(size))], [np.zeros(len(size), dtype=np.int64)]  # item 0: any word
    h = np.zeros(len(one), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            nxt = np.concatenate([one[n - 1 :], np.zeros(n - 1, dtype=np.uint64)])[: len(one)]
            h = h * np.uint64(0x100000001B3) + nxt + np.uint64(1)
            if n in SIZES:
                full = left >= n
                mixed = h[full] ^ np.uint64(n)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                owners.append(owner[full])
                items.append((mixed >> np.uint64(40)).astype(np.int64) % (NGRAMS - 1) + 1)
    owners, items = np.concatenate(owners), np.concatenate(items)
    order = np.argsort(owners, kind="stable")
    return np.searchsorted(owners[order], np.arange(len(size))), items[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Network:
    """Weights; directions are stacked: index 0 reads forward, 1 backward."""

    vocabulary: dict[str, int]
    word: np.ndarray
    char: np.ndarray
    w: np.ndarray  # (2, inputs, 3 hidden), gates in the order update, reset, new
    u: np.ndarray  # (2, hidden, 3 hidden)
    b: np.ndarray
    att: np.ndarray  # (2 hidden, hidden)
    key: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word rows, word vectors, chosen n-gram per character dimension) of different words."""
        ids = np.array([self.vocabulary.get(w.strip(_EDGE), 0) for w in words], dtype=np.int64)
        first, items = ngrams(words)
        values = self.char[items]
        top = np.maximum.reduceat(values, first, axis=0)
        return ids, np.concatenate([self.word[ids], top], axis=1), items

    def lookup(self, tokens: list[str]) -> np.ndarray:
        """Row numbers of tokens in the vector table; the table starts anew beyond CACHE words."""
        known = self._known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if len(known) + len(new) > CACHE and known:
            known.clear()
            self._rows.clear()
            new = list(dict.fromkeys(tokens))
        for a in range(0, len(new), CHUNK):
            part = new[a : a + CHUNK]
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self._rows.append(self.inputs(part)[1].astype(np.float32))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def table(self) -> np.ndarray:
        if len(self._rows) > 1:
            self._rows[:] = [np.concatenate(self._rows)]
        return self._rows[0]

    def windows(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits of windows: `at` (windows, steps) are rows of the word vectors `x`."""
        n, steps = at.shape
        k = HIDDEN
        w, u, b = (a.astype(np.float32) for a in (self.w, self.u, self.b))
        gates = [x @ w[d] + b[d] for d in (0, 1)]
        states = np.empty((steps, n, 2 * k), dtype=np.float32)
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            h = np.zeros((n, k), dtype=np.float32)
            for t in order:
                g = gates[d][at[:, t]]
                hu = h @ u[d]
                zr = _sigmoid(g[:, : 2 * k] + hu[:, : 2 * k])
                new = np.tanh(g[:, 2 * k :] + zr[:, k:] * hu[:, 2 * k :])
                nxt = new + zr[:, :k] * (h - new)
                h = nxt if mask is None else np.where(mask[:, t, None], nxt, h)
                states[t, :, d * k : (d + 1) * k] = h
        e = np.tanh(states @ self.att.astype(np.float32)) @ self.key.astype(np.float32)  # (steps, windows)
        if mask is not None:
            e = np.where(mask.T, e, np.float32(-30))
        a = np.exp(e - e.max(axis=0))
        pooled = np.einsum("tn,tnk->nk", a / a.sum(axis=0), states)
        return pooled @ self.out.astype(np.float32) + np.float32(self.bias)

    def text_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit of each text, and where that window begins."""
        logits, best = np.full(len(texts), -np.inf), np.zeros(len(texts), dtype=np.int64)
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append((i, words_of(text) or [""]))
            size += len(group[-1][1])
            if size >= GROUP or i == len(texts) - 1:
                rows = self.lookup([w for _, ws in group for w in ws])
                uniq, at = np.unique(rows, return_inverse=True)
                x = self.table()[uniq]
                owner, start, length, base = [], [], [], 0
                for j, ws in group:
                    n = len(ws)
                    begins = range(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else (0,)
                    for s in begins:
                        s = min(s, max(n - WINDOW, 0))
                        owner.append(j)
                        start.append(s)
                        length.append((base + s, min(WINDOW, n)))
                    base += n
                owner_, start_ = np.array(owner), np.array(start)
                first, steps = np.array(length).T
                score = np.empty(len(owner_))
                for whole in (True, False):
                    pick = np.flatnonzero((steps == WINDOW) == whole)
                    for a in range(0, len(pick), 1024):
                        p = pick[a : a + 1024]
                        if whole:
                            score[p] = self.windows(x, at[first[p, None] + np.arange(WINDOW)], None)
                        else:
                            mask = np.arange(WINDOW) < steps[p, None]
                            where = first[p, None] + np.minimum(np.arange(WINDOW), steps[p, None] - 1)
                            score[p] = self.windows(x, at[where], mask)
                order = np.lexsort((-score, owner_))
                lead = order[np.concatenate([[True], owner_[order][1:] != owner_[order][:-1]])]
                logits[owner_[lead]], best[owner_[lead]] = score[lead], start_[lead]
                group, size = [], 0
        return logits, best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return _sigmoid(self.scale * (self.text_logits(texts)[0] - self.shift) + np.log(THRESHOLD / (1 - THRESHOLD)))


def _association(hits: np.ndarray, misses: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Initial value of a word or n-gram: how many standard errors its rates differ by."""
    pooled = (hits + misses) / (toxic + clean)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / toxic + 1 / clean))
    z = (hits / toxic - misses / clean) / error
    return np.where(np.abs(z) > 4, np.clip(z / 6, -1, 2), 0.0) * (hits + misses >= 3)


def _step(net: Network, tokens: list[list[str]], y: np.ndarray, moments: dict, t: int) -> None:
    """One Adam step on windows of words."""
    k, n, steps = HIDDEN, len(tokens), WINDOW
    uniq = {w: i for i, w in enumerate(dict.fromkeys(w for ws in tokens for w in ws))}
    ids, x, _ = net.inputs(list(uniq))
    first, items = ngrams(list(uniq))
    at = np.zeros((n, steps), dtype=np.int64)
    mask = np.zeros((n, steps), dtype=bool)
    for i, ws in enumerate(tokens):
        at[i, : len(ws)] = [uniq[w] for w in ws]
        mask[i, : len(ws)] = True
    states = np.zeros((steps, n, 2 * k))
    kept = {}
    for d, order in ((0, list(range(steps))), (1, list(range(steps - 1, -1, -1)))):
        gate = x @ net.w[d] + net.b[d]
        h = np.zeros((n, k))
        for s in order:
            g, hu = gate[at[:, s]], h @ net.u[d]
            zr = _sigmoid(g[:, : 2 * k] + hu[:, : 2 * k])
            new = np.tanh(g[:, 2 * k :] + zr[:, k:] * hu[:, 2 * k :])
            m = mask[:, s, None]
            kept[d, s] = (h, zr, new, hu[:, 2 * k :])
            h = np.where(m, new + zr[:, :k] * (h - new), h)
            states[s, :, d * k : (d + 1) * k] = h
    act = np.tanh(states @ net.att)
    e = np.where(mask.T, act @ net.key, -30.0)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", a, states)
    p = _sigmoid(pooled @ net.out + net.bias)
    g_logit = (p - y) / n
    grads = {"out": pooled.T @ g_logit + 1e-4 * net.out, "bias": g_logit.sum()}
    g_pool = g_logit[:, None] * net.out
    g_states = a[:, :, None] * g_pool
    g_a = np.einsum("nk,tnk->tn", g_pool, states)
    g_e = a * (g_a - (a * g_a).sum(axis=0)) * mask.T
    g_act = g_e[:, :, None] * net.key * (1 - act**2)
    grads["key"] = np.einsum("tn,tnk->k", g_e, act)
    grads["att"] = np.einsum("tnj,tnk->jk", states, g_act)
    g_states += g_act @ net.att.T
    g_x = np.zeros_like(x)
    g_w, g_u, g_b = np.zeros_like(net.w), np.zeros_like(net.u), np.zeros_like(net.b)
    for d, order in ((0, range(steps - 1, -1, -1)), (1, range(steps))):
        carry = np.zeros((n, k))
        for s in order:
            h, zr, new, hn = kept[d, s]
            m = mask[:, s, None]
            total = carry + g_states[s, :, d * k : (d + 1) * k]
            gh = np.where(m, total, 0.0)
            z, r = zr[:, :k], zr[:, k:]
            g_new = gh * (1 - z) * (1 - new**2)
            g_z = gh * (h - new) * z * (1 - z)
            g_r = g_new * hn * r * (1 - r)
            g_gate = np.concatenate([g_z, g_r, g_new], axis=1)
            g_hu = np.concatenate([g_z, g_r, g_new * r], axis=1)
            g_u[d] += h.T @ g_hu
            g_b[d] += g_gate.sum(axis=0)
            g_w[d] += x[at[:, s]].T @ g_gate
            np.add.at(g_x, at[:, s], g_gate @ net.w[d].T)
            carry = np.where(m, gh * z + g_hu @ net.u[d].T, total)
    grads |= {"w": g_w, "u": g_u, "b": g_b}
    g_word, g_char = np.zeros_like(net.word), np.zeros_like(net.char)
    np.add.at(g_word, ids, g_x[:, :WORD_DIM])
    owner = np.repeat(np.arange(len(first)), np.diff(first, append=len(items)))
    is_top = net.char[items] == x[owner, WORD_DIM:]
    rows, dims = np.nonzero(is_top)
    np.add.at(g_char, (items[rows], dims), g_x[owner[rows], WORD_DIM + dims])
    grads |= {"word": g_word, "char": g_char}
    for name, g in grads.items():
        m1, m2 = moments.get(name, (0.0, 0.0))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        moments[name] = (m1, m2)
        move = RATES.get(name, 0.01) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        setattr(net, name, getattr(net, name) - move)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """Fits the network; None without rows of both labels."""
    y = np.array(labels, dtype=float)
    toxic, clean = int(y.sum()), int((1 - y).sum())
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    shared: dict[str, str] = {}  # one object per word
    tokens = [[shared.setdefault(w, w) for w in words_of(t)] for t in texts]
    seen = [list(dict.fromkeys(shared.setdefault(w, w) for w in (x.strip(_EDGE) for x in ws))) for ws in tokens]
    counts: dict[str, list[int]] = {}
    for ws, label in zip(seen, labels, strict=True):
        for w in ws:
            counts.setdefault(w, [0, 0])[label] += 1
    words = sorted((w for w, c in counts.items() if sum(c) > 1), key=lambda w: (-sum(counts[w]), w))[: VOCABULARY - 1]
    vocabulary = {w: i + 1 for i, w in enumerate(words)}
    grams = np.zeros((2, NGRAMS))
    met = np.cumsum([len(ws) for ws in seen])
    a = 0
    while a < len(seen):
        # A text's n-grams count once, however often it has them; about CHUNK words at a time.
        b = max(a + 1, int(np.searchsorted(met, (met[a - 1] if a else 0) + CHUNK, side="right")))
        part = [(i, w) for i, ws in enumerate(seen[a:b]) for w in ws]
        if part:
            first, items = ngrams([w for _, w in part])
            text = np.repeat(np.array([i for i, _ in part]), np.diff(first, append=len(items)))
            both = np.unique(text * NGRAMS + items)
            np.add.at(grams, (y[a + both // NGRAMS].astype(int), both % NGRAMS), 1)
        a = b
    small = lambda *shape: rng.normal(0, 0.1, shape)
    d = WORD_DIM + CHAR_DIM
    net = Network(
        vocabulary, small(len(words) + 1, WORD_DIM) / 5, small(NGRAMS, CHAR_DIM) / 5, small(2, d, 3 * HIDDEN) * 2,
        small(2, HIDDEN, 3 * HIDDEN) * 2, np.zeros((2, 3 * HIDDEN)), small(2 * HIDDEN, HIDDEN) * 2, small(HIDDEN) * 2, small(2 * HIDDEN) * 2,
    )
    net.word[0] = 0
    hits = np.array([counts[w][1] for w in words], dtype=float)
    misses = np.array([counts[w][0] for w in words], dtype=float)
    net.word[1:, 0] = _association(hits, misses, toxic, clean)
    net.char[:, 0] = _association(grams[1], grams[0], toxic, clean)
    net.b[:, :HIDDEN] = 1.0  # states last at first
    best = np.zeros(len(texts), dtype=np.int64)
    for i, ws in enumerate(tokens):
        if len(ws) > WINDOW and y[i]:
            value = np.array([net.word[vocabulary.get(w.strip(_EDGE), 0), 0] for w in ws])
            best[i] = min(int(value.argmax()) // STRIDE * STRIDE, len(ws) - WINDOW)
    moments: dict = {}
    balance = np.concatenate([np.flatnonzero(y == 1)] * max(1, round(clean / toxic / 2)) + [np.flatnonzero(y == 0)])
    order = balance[:0]
    for t in range(1, STEPS + 1):
        if t in (STEPS // 4, STEPS // 4 * 3):
            net._known.clear()
            net._rows.clear()
            best = net.text_logits(texts)[1]
        if not len(order):
            order = rng.permutation(balance)
        part, order = order[:BATCH], order[BATCH:]
        batch = []
        for i in part:
            ws, s = tokens[i], int(best[i])
            if not y[i] and rng.random() < 0.5:
                s = int(rng.integers(0, max(len(ws) - WINDOW, 0) + 1))
            batch.append(ws[s : s + WINDOW] or [""])
        _step(net, batch, y[part], moments, t)
    net._known.clear()
    net._rows.clear()
    logit = net.text_logits(texts)[0]
    net.scale, net.shift = 1.0, _cut(logit, y)
    net._known.clear()
    net._rows.clear()
    return net


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates the training texts best: the middle of the best gap."""
    order = np.argsort(logit)
    x, label = logit[order], y[order]
    right = (label == 0).cumsum() + label[::-1].cumsum()[::-1] - label  # clean at or below, toxic above
    best = np.flatnonzero(right == right.max())
    i = best[np.argmax(np.append(np.diff(x), 2.0)[best])]
    return float((x[i] + (x[i + 1] if i + 1 < len(x) else x[i] + 2)) / 2)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Trains on a bounded sample: one text of each labelled id that hashes lowest."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out("doc_id")).withColumn("_order", F.xxhash64("doc_id", F.lit("sample")))
    parts = [known.where("toxic = 1").orderBy("_order").limit(MAX_TOXIC), known.where("toxic = 0").orderBy("_order").limit(MAX_CLEAN)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= MAX_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))
    rows = rows.collect()  # MAX_TOXIC + MAX_CLEAN texts
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["_toxic"] for r in rows])


def _scorer(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part.column("_text").to_pylist()
                score = model.scores(texts) if model else np.zeros(len(texts))
                others = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(score, pa.float64())], names=[*others, "_score"])

    return run


def _scored(rows: DataFrame, net: Network | None) -> DataFrame:
    """`rows` has a `_text` column, which is replaced by `_score`."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    schema = rows.drop("_text").schema.add("_score", "double")
    return rows.mapInArrow(_scorer(shared), schema)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    rows = _scored(docs.select("doc_id", F.col("text").alias("_text")), net)
    predicted = (F.col("_score") >= THRESHOLD).cast("int")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def accepted(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    rows = _scored(packed(docs, "text"), net).where(F.col("_score") < THRESHOLD)
    return unpacked(rows, docs.columns)
