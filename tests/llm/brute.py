"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def repeated_bytes(docs, length):
    """{id: (n_bytes, n_removed, n_spans, rest)} of (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        spans = sum(1 for p in range(len(data)) if gone[p] and (not p or not gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs, radius=2):
    """[(fingerprint, smallest id)] in the order of docs."""
    prints = [fingerprint(t) for _, t in docs]
    g = Groups(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                g.join(a, b)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            r = g.find(k)
            low[r] = min(low.get(r, i), i)
    return [(f"{prints[k]:016x}", low.get(g.find(k))) for k in range(len(docs))]


def line_runs(docs, n, long=50):
    """[(n_lines, n_removed, n_runs, reach, rest)] in the order of (id, text) pairs with ids in order."""
    seen, out = set(), []
    for _, text in docs:
        lines = (text or "").split("\n")
        full = [k for k, line in enumerate(lines) if WORD.search(line)]
        gone, reach = set(), 0
        sizes = {n * 2**k for k in range(20) if n * 2**k <= len(full)}
        for size in sorted(sizes | {1}):
            for s in range(len(full) - size + 1):
                run = tuple(lines[k] for k in full[s : s + size])
                counts = size > 1 or n == 1 or len(WORD.findall(run[0])) >= long
                if run in seen and counts:
                    gone.update(range(s, s + size))
                    reach = max(reach, size)
                seen.add(run)
        cut = {full[s] for s in gone}
        rest = "\n".join(line for k, line in enumerate(lines) if k not in cut)
        out.append((len(full), len(gone), sum(1 for s in gone if s - 1 not in gone), reach, rest))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def vector_links(vectors, cosine=0.95):
    """[(n_links, index of the smallest linked)] of rows of a matrix."""
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    g = Groups(len(u))
    for a, b in zip(*np.nonzero(hit), strict=True):
        g.join(a, b)
    return [(int(hit[i].sum()), g.find(i)) for i in range(len(u))]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
