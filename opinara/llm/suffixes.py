"""Removal of repeated 100-byte strings with suffix arrays built shard by shard.

Texts are whole UTF-8 byte strings.  A byte goes when it lies in a string of `length` bytes
that also starts earlier: in a smaller (id, copy), or earlier in the same text.

1. *Shards.* Every window of `length` bytes is named by the smallest hash of its `GRAM`-byte
   substrings (its anchor), so equal windows, wherever they are, have equal anchors.  Windows
   that share one anchor position form a segment of at most `length - GRAM + 1` windows.  Only
   anchors seen twice go on, and equal segments of one anchor are folded to their first copy:
   all windows of the others start later, hence are repeated.
2. *Suffix arrays.* The folded segments of an anchor meet in one task, anchors in small shards.
   A shard's array is built by induced sorting: suffixes are classified, the leftmost-smaller
   (LMS) substrings are sorted by one induction and named, their order is completed
   recursively on the names, and a second induction orders all suffixes in linear time.
   Permuted common prefixes come from the irreducible positions.  Neighbours that share
   `length` bytes are one string; all its starts but the earliest are repeated.
3. *Removal.* Repeated starts return to their text as runs; the union of the windows goes.

Inductions run bucket by bucket as array operations.  A name alphabet is too wide for that, so
the recursive step names pairs of names (each round doubles the reach) until order is settled.

Hot anchors: an anchor with more than `HOT` different segments is not gathered; its segments
go on window by window, named by their content, and equal windows are folded where they are
read.  No case is dropped.

Defined results: null texts are empty; ids may repeat (such rows are ordered by a hash of their text) and may
be null (they sort first); texts shorter than `length` lose nothing; an empty table gives no
rows; other columns are ignored.  Removal may cut a character; texts are decoded without the
broken bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.common import numbered, rewritten, set_apart

LENGTH = 100
GRAM = 32
HOT = 30_000
# Bytes of text per suffix array, and of texts hashed at once.
SHARD_BYTES = 1 << 19
BLOCK_BYTES = 1 << 20

_U = np.uint64
_SPREAD = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE2 = _U(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- suffix arrays


def _last_true(mask: np.ndarray) -> np.ndarray:
    """Index of the last true position at or before each position (-1: none)."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask), dtype=np.int32), np.int32(-1)))


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than their right neighbour)."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int32), append=-1))[::-1]
    at = _last_true(step != 0)  # the last symbol always differs from the end
    return (step[at] > 0)[::-1] if n else np.zeros(0, dtype=bool)


def _scatter(sa: np.ndarray, at: np.ndarray, suffixes: np.ndarray, s: np.ndarray, forward: bool) -> None:
    """Appends suffixes to the fronts (or backs) of their buckets, keeping their order."""
    order = np.argsort(s[suffixes], kind="stable")
    suffixes = suffixes[order]
    symbols = s[suffixes]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    size = np.diff(first, append=len(symbols))
    within = np.arange(len(symbols)) - np.repeat(first, size)
    heads = np.repeat(at[symbols[first]], size)
    if forward:
        sa[heads + within] = suffixes
        at[symbols[first]] += size
    else:
        sa[heads - within - 1] = suffixes
        at[symbols[first]] -= size


def induce(s: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that `lms` (in order within each symbol) induces."""
    n = len(s)
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, dtype=np.int32)
    lms_of = np.bincount(s[lms], minlength=len(counts))
    seeds = lms[np.argsort(s[lms], kind="stable")]
    lms_end = np.cumsum(lms_of)
    front = starts.copy()
    # The empty suffix at the end comes first of all and induces the last symbol.
    if not s_type[n - 1]:
        sa[front[s[n - 1]]] = n - 1
        front[s[n - 1]] += 1
    for c in np.flatnonzero(counts):
        done, parts = starts[c], []
        while done < front[c]:
            batch = sa[done : front[c]]
            done = front[c]
            before = batch[batch > 0] - 1
            before = before[~s_type[before]]
            own = s[before] == c
            if own.any():
                # Equal symbols stay in this bucket and are scanned in the next turn.
                more = before[own]
                sa[front[c] : front[c] + len(more)] = more
                front[c] += len(more)
                before = before[~own]
            parts.append(before)
        stars = seeds[lms_end[c] - lms_of[c] : lms_end[c]]
        if len(stars):
            parts.append(stars[stars > 0] - 1)
        before = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        if len(before):
            _scatter(sa, front, before, s, True)
    back = ends.copy()
    for c in np.flatnonzero(counts)[::-1]:
        done, parts = ends[c], []
        while done > back[c]:
            batch = sa[back[c] : done][::-1]
            done = back[c]
            before = batch[batch > 0] - 1
            before = before[s_type[before]]
            own = s[before] == c
            if own.any():
                more = before[own]
                sa[back[c] - len(more) : back[c]] = more[::-1]
                back[c] -= len(more)
                before = before[~own]
            parts.append(before)
        larger = sa[starts[c] : front[c]][::-1]
        if len(larger):
            before = larger[larger > 0] - 1
            parts.append(before[s_type[before]])
        before = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        if len(before):
            _scatter(sa, back, before, s, False)
    return sa


def _order_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names, by recursively naming pairs of names.

    Only names that still occur more than once are looked at again.
    """
    m = len(names)
    rank = names.astype(np.int64)
    reach = 1
    while True:
        size = np.bincount(rank, minlength=m)
        open_at = np.flatnonzero(size[rank] > 1)
        if not len(open_at):
            order = np.empty(m, dtype=np.int64)
            order[rank] = np.arange(m)
            return order
        following = open_at + reach
        second = np.where(following < m, rank[np.minimum(following, m - 1)] + 1, 0)
        pair = rank[open_at] * (m + 1) + second
        sort = np.argsort(pair, kind="stable")
        pair, open_at = pair[sort], open_at[sort]
        new_group = np.concatenate([[True], rank[open_at][1:] != rank[open_at][:-1]])
        new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
        at = np.arange(len(pair))
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        pair_start = np.maximum.accumulate(np.where(new_pair, at, 0))
        fresh = rank.copy()
        fresh[open_at] = rank[open_at] + pair_start - group_start
        rank = fresh
        reach *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string of small non-negative symbols."""
    s = np.ascontiguousarray(s, dtype=np.uint16)
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    s_type = suffix_types(s)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    m = len(lms)
    if m > 1:
        sa = induce(s, s_type, lms)
        by_substring = sa[is_lms[sa]]
        # Equal neighbours among the sorted LMS substrings get one name.
        end = np.empty(n, dtype=np.int32)
        end[lms] = np.append(lms[1:], n - 1)
        a, b = by_substring[:-1], by_substring[1:]
        span = end[a] - a
        differs = span != end[b] - b
        differs |= (end[a] == n - 1) | (end[b] == n - 1)
        left = np.flatnonzero(~differs)
        k = 0
        while len(left):
            unequal = s[a[left] + k] != s[b[left] + k]
            differs[left[unequal]] = True
            left = left[~unequal]
            k += 1
            left = left[span[left] >= k]
        group = np.concatenate([[0], np.where(differs, np.arange(1, m), 0)])
        name = np.empty(n, dtype=np.int64)
        name[by_substring] = np.maximum.accumulate(group)  # a name is its group's first rank
        lms = lms[_order_names(name[lms])]
    return induce(s, s_type, lms)


def common_prefixes(s: np.ndarray, symbols: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Permuted common prefixes: for each position, the prefix (up to `limit`) that its suffix
    shares with the one before it in the array.

    Positions whose left neighbour differs from that of their predecessor are irreducible and
    are compared symbol by symbol; every other value is one less than the value to its left.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    reducible = (at > 0) & (phi > 0)
    reducible[reducible] = symbols[at[reducible] - 1] == symbols[phi[reducible] - 1]
    root = np.flatnonzero(~reducible)
    plcp = np.zeros(n, dtype=np.int32)
    word = 8
    text = np.zeros(n + 2 * word, dtype=np.uint8)
    text[:n] = s
    eights = np.lib.stride_tricks.sliding_window_view(text, word)
    # An irreducible value must reach past the limit by its distance to the next root, or
    # else the values to its right would be cut short.
    gap = np.diff(root, append=n)
    need = limit + gap
    left = root[phi[root] >= 0]
    goal = need[phi[root] >= 0]
    shared = np.zeros(len(left), dtype=np.int64)
    active = np.arange(len(left))
    while len(active):
        i, j = left[active] + shared[active], phi[left[active]] + shared[active]
        room = n - np.maximum(i, j)
        x = (eights[np.minimum(i, n)] ^ eights[np.minimum(j, n)]).view(np.uint64).ravel()
        zeros = np.where(x == 0, word, np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.int64) // 8)
        grown = np.minimum(zeros, room)
        shared[active] += grown
        active = active[(grown == word) & (shared[active] < goal[active])]
    plcp[left] = shared
    start = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.minimum(np.maximum(plcp[start] - (at - start), 0), limit)


def repeated_windows(texts: list[bytes], order: list[tuple], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(text number, start, windows) of windows that a text earlier in `order` starts as well.

    `order[i]` is the place in the corpus of text i's first byte, as a comparable tuple whose
    last element advances by one per byte.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    s = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    symbols = s.astype(np.uint16) + 1
    first = np.cumsum(sizes + 1) - sizes - 1
    symbols[first + sizes] = 0  # separators are smaller than every byte
    sa = suffix_array(symbols)
    # Windows never reach a separator, so bytes alone decide: values beyond it don't matter.
    plcp = common_prefixes(s, symbols, sa, length)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    inner = np.arange(len(s), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes + 1)
    window = inner + length <= sizes[owner]
    # Suffixes that end within `length` bytes sit between strings; they end an interval.
    with_previous = (plcp[sa] >= length) & window[sa]
    with_previous[1:] &= window[sa[:-1]]
    with_previous[0] = False
    begins = np.flatnonzero(~with_previous)
    many = np.diff(begins, append=len(sa)) > 1
    if not many.any():
        return
    member = np.repeat(many, np.diff(begins, append=len(sa)))
    interval = np.cumsum(~with_previous, dtype=np.int32)[member]
    at = sa[member]
    place = np.array([(o[0], o[1], o[2]) for o in order], dtype=np.int64)
    key0, key1, key2 = place[owner[at], 0], place[owner[at], 1], place[owner[at], 2] + inner[at]
    by = np.lexsort((key2, key1, key0, interval))
    at, interval = at[by], interval[by]
    earliest = np.concatenate([[True], interval[1:] != interval[:-1]])
    later = np.sort(at[~earliest])
    breaks = np.flatnonzero(np.diff(later) != 1) + 1
    for run in np.split(later, breaks):
        yield int(owner[run[0]]), int(inner[run[0]]), len(run)


# ---------------------------------------------------------------- anchors


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the GRAM bytes from each position, and the hashes of single bytes."""
    one = _SPREAD[data]
    h, reach, power = one, 1, _BASE
    while reach < GRAM:
        h = h[:-reach] * power + h[reach:]
        power, reach = power * power, reach * 2
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32)), one


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: every window's anchor, the hashes of single bytes, and the
    windows at which a new segment begins."""
    h, one = _grams(data)
    span = length - GRAM + 1
    low, reach = h, 1
    while reach * 2 <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    if reach < span:
        low = np.minimum(low[: -(span - reach)], low[span - reach :])
    # A new segment begins where the anchor changes, or where it was the first gram just left.
    return low, one, np.flatnonzero((low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])) + 1


def _digests(one: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each byte range; an anchor's own 64 bits come on top of it."""
    total = stop - start
    power = np.ones(int(total.max(initial=1)) + 1, dtype=np.uint64)
    power[1:] = _BASE2
    power = np.multiply.accumulate(power)
    out = np.zeros(len(start), dtype=np.uint64)
    mixed = one ^ (one >> _U(31))
    chunk = 200_000 // 64
    for a in range(0, len(start), chunk):
        size = total[a : a + chunk]
        edge = np.concatenate([[0], np.cumsum(size)])
        inner = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
        values = mixed[np.repeat(start[a : a + chunk], size) + inner] * power[inner]
        out[a : a + chunk] = np.add.reduceat(values, edge[:-1]) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    return out ^ (out >> _U(29))


def _find_segments(length: int):
    """Per batch of texts: one row per segment (anchor, digest, key, copy, start, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, size = [], 0
            keys, copies = np.asarray(batch.column("_key")), np.asarray(batch.column("_copy"))
            for key, copy, text in zip(keys, copies, batch.column("text"), strict=True):
                data = text.as_py().encode()
                # Very long texts go in blocks; a block's windows end where the next's begin.
                for at in range(0, len(data) - length + 1, BLOCK_BYTES):
                    part = data[at : at + BLOCK_BYTES + length - 1]
                    if group and size + len(part) > BLOCK_BYTES:
                        yield _segment_batch(group, length)
                        group, size = [], 0
                    group.append((key, copy, at, part))
                    size += len(part)
            if group:
                yield _segment_batch(group, length)

    return run


def _segment_batch(group: list[tuple], length: int) -> pa.RecordBatch:
    with np.errstate(over="ignore"):  # hashes wrap around
        return _segments_of(group, length)


def _segments_of(group: list[tuple], length: int) -> pa.RecordBatch:
    key, copy, offset, texts = zip(*group, strict=True)
    keys, copies, offsets = np.array(key), np.array(copy, dtype=np.int64), np.array(offset, dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    low, one, breaks = segments(data, length)
    stops = first + sizes - length + 1  # where each text's windows end
    marks = np.unique(np.concatenate([breaks, first, stops[stops < len(low)]]))
    owner = np.searchsorted(first, marks, side="right") - 1
    inside = marks < stops[owner]
    marks, owner, after = marks[inside], owner[inside], np.append(marks[1:], len(low))[inside]
    windows = np.minimum(after, stops[owner]) - marks
    digest = _digests(one, marks, marks + windows + length - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(low[marks].view(np.int64)),
            pa.array(digest.view(np.int64)),
            pa.array(keys[owner]),
            pa.array(copies[owner]),
            pa.array((marks - first[owner] + offsets[owner]).astype(np.int32)),
            pa.array(windows.astype(np.int32)),
        ],
        names=["anchor", "digest", "_key", "_copy", "start", "windows"],
    )


_SEGMENT = "anchor long, digest long, _key long, _copy long, start int, windows int"
_MARK = "anchor long, _key long, _copy long, start int, windows int, first boolean, hot boolean"
_TEXT = ("_key", "_copy")
_MARKED = ("anchor", "_key", "_copy", "start", "windows")


def _fold(hot: int):
    """Segments sorted by (anchor, digest, place): later copies of a segment, and the first copy
    of every segment whose anchor has different ones.  Anchors met once leave here.

    Between batches it holds the first copies of one anchor, `hot` rows at most: beyond that
    the anchor is marked hot and streams on.
    """

    def marks(part: pa.RecordBatch, first: bool, is_hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column(c) for c in _MARKED] + [pa.array(np.full(part.num_rows, first)), pa.array(is_hot)],
            names=[*_MARKED, "first", "hot"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = digest = None
        held: list[pa.RecordBatch] = []
        n_held, streams = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            a, d = np.asarray(batch.column("anchor")), np.asarray(batch.column("digest"))
            new_a = np.concatenate([[a[0] != anchor], a[1:] != a[:-1]])
            new_d = new_a | np.concatenate([[d[0] != digest], d[1:] != d[:-1]])
            anchor, digest = a[-1], d[-1]
            if not new_d.all():
                late = batch.filter(pa.array(~new_d))
                yield marks(late, False, np.zeros(late.num_rows, dtype=bool))
            firsts = batch.filter(pa.array(new_d))
            group = np.cumsum(new_a)  # group 0 continues the anchor of the batch before
            last = group[-1]
            group = group[new_d]
            total = np.bincount(group, minlength=last + 1)
            total[0] += n_held
            crowded = total > hot
            crowded[0] |= streams
            if last > 0 or crowded[0]:
                for part in held if total[0] > 1 else ():
                    yield marks(part, True, np.full(part.num_rows, crowded[0]))
                held, n_held = [], 0
                # A group of one batch that hangs over stays open: it is judged with the next.
                goes = (total[group] > 1) & ((group < last) | crowded[group]) | (group == 0) & crowded[0]
                if goes.any():
                    yield marks(firsts.filter(pa.array(goes)), True, crowded[group[goes]])
                stays = firsts.filter(pa.array((group == last) & ~crowded[group]))
            else:
                stays = firsts
            streams = bool(crowded[last])
            if stays.num_rows:
                held.append(stays)
                n_held += stays.num_rows
        if n_held > 1:
            for part in held:
                yield marks(part, True, np.zeros(part.num_rows, dtype=bool))

    return run


_BYTES = "anchor long, bytes binary, _key long, _copy long, start int"


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """First position of each row's items (and the end), and the items' fields."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    items = column.flatten()
    return np.concatenate([[0], np.cumsum(lengths)]), {f.name: np.asarray(items.field(f.name)) for f in items.type}


def _cut_out(length: int):
    """The bytes of first copies; those of hot anchors window by window, named by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            edge, m = _lists(batch.column("marks"))
            wanted = np.flatnonzero(m["first"])
            owner = np.searchsorted(edge, wanted, side="right") - 1
            copies, keys = np.asarray(batch.column("_copy")), np.asarray(batch.column("_key"))
            texts = batch.column("text")
            at, data = -1, b""
            for i, row in zip(wanted.tolist(), owner.tolist(), strict=True):
                if row != at:
                    at, data = row, texts[row].as_py().encode()
                start, stop = int(m["start"][i]), int(m["start"][i] + m["windows"][i]) + length - 1
                key, copy = int(keys[row]), int(copies[row])
                if not m["hot"][i]:
                    out.append((int(m["anchor"][i]), data[start:stop], key, copy, start))
                else:
                    for j in range(start, stop - length + 1):
                        window = data[j : j + length]
                        name = hashlib.blake2b(window, digest_size=8).digest()
                        out.append((int.from_bytes(name, "big", signed=True), window, key, copy, j))
                if len(out) >= 5000:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, k, c, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int32())],
        names=["anchor", "bytes", "_key", "_copy", "start"],
    )


_RUN = "_key long, _copy long, start int, windows int"


def _search(length: int):
    """Rows sorted by anchor: whole anchors are gathered into shards of SHARD_BYTES, and each
    shard's suffix array names the repeated windows.  Equal byte strings are folded first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        found: list[tuple] = []
        size, last = 0, None

        def close() -> None:
            nonlocal size
            texts = list(first)
            places = [first[t] for t in texts]
            for i, start, windows in repeated_windows(texts, places, length):
                key, copy, at = places[i]
                found.append((key, copy, at + start, windows))
            first.clear()
            size = 0

        for batch in batches:
            for anchor, text, key, copy, start in zip(*(batch.column(c).to_pylist() for c in ("anchor", "bytes", "_key", "_copy", "start")), strict=True):
                if anchor != last:
                    if size >= SHARD_BYTES:
                        close()
                    last = anchor
                place, known = (key, copy, start), first.get(text)
                if known is None:
                    first[text] = place
                    size += len(text)
                else:
                    late, first[text] = max(place, known), min(place, known)
                    found.append((*late, len(text) - length + 1))
            if len(found) >= 5000:
                yield _runs(found)
                found = []
        if first:
            close()
        if found:
            yield _runs(found)

    return run


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    k, c, s, w = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int32()), pa.array(w, pa.int32())],
        names=["_key", "_copy", "start", "windows"],
    )


# ---------------------------------------------------------------- whole corpus


def marked(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(_key, _copy, marks): the repeated segments of each text, which bounds them."""
    found = rows.mapInArrow(_find_segments(length), _SEGMENT)
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "digest", "_key", "_copy", "start")
    marks = dealt.mapInArrow(_fold(hot), _MARK)
    return marks.groupBy(*_TEXT).agg(F.collect_list(F.struct("anchor", "start", "windows", "first", "hot")).alias("marks"))


def searched(rows: DataFrame, marks: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_key, _copy, runs): repeated windows inside first copies, found by the shards' arrays."""
    pieces = rows.join(marks, list(_TEXT)).mapInArrow(_cut_out(length), _BYTES)
    runs = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search(length), _RUN)
    return runs.groupBy(*_TEXT).agg(F.collect_list(F.struct("start", "windows")).alias("runs"))


def _removed(start: np.ndarray, windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of runs of repeated windows."""
    if not len(start):
        return []
    order = np.argsort(start)
    start = start[order].astype(np.int64)
    stop = np.maximum.accumulate(start + windows[order] + length - 1)
    opens = np.concatenate([[True], start[1:] > stop[:-1]])
    closes = np.append(np.flatnonzero(opens)[1:] - 1, len(start) - 1)
    return list(zip(start[opens].tolist(), stop[closes].tolist(), strict=True))


def _rewrite(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            (e0, m), (e1, r) = _lists(batch.column("marks")), _lists(batch.column("runs"))
            for i, (n, text) in enumerate(zip(batch.column("_n").to_pylist(), batch.column("text"), strict=True)):
                late, run_ = slice(e0[i], e0[i + 1]), slice(e1[i], e1[i + 1])
                mine = ~m["first"][late]
                start = np.concatenate([m["start"][late][mine], r["start"][run_]])
                windows = np.concatenate([m["windows"][late][mine], r["windows"][run_]])
                data = text.as_py().encode()
                # A later row equal in id and text starts after the first in every string.
                cuts = _removed(start, windows, length) if n == 1 else [(0, len(data))] * (len(data) >= length)
                at, parts = 0, []
                for a, b in cuts:
                    parts.append(data[at:a])
                    at = b
                rest = b"".join([*parts, data[at:]]) if cuts else data
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                spans.append([{"start": a, "stop": b} for a, b in cuts])
                kept.append(rest.decode(errors="ignore") if with_text else hashlib.sha256(rest).hexdigest())
            names = [c for c in batch.schema.names if c not in ("text", "_n", "marks", "runs")]
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(spans, spans_type),
                    pa.array(kept, pa.string()),
                ],
                names=[*names, "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, _key, _copy, n_bytes, n_removed, spans, kept): kept is the remaining text, or the
    SHA-256 of the remaining bytes when `with_text` is false."""
    rows = numbered(docs, id_col, text_col, carry)
    first = rows.where("_n = 1")
    marks = marked(first, length, hot)
    runs = searched(first, marks, length)
    joined = rows.join(marks, list(_TEXT), "left").join(runs, list(_TEXT), "left")
    joined = joined.select(F.col(id_col), *carry, *_TEXT, "text", "_n", "marks", "runs")
    schema = joined.select(id_col, *carry, "_key", "_copy").schema.add("n_bytes", "long").add("n_removed", "long")
    span = T.StructType().add("start", "long").add("stop", "long")
    schema = schema.add("spans", T.ArrayType(span)).add("kept", "string")
    return joined.mapInArrow(_rewrite(length, with_text), schema)


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with the remaining texts, all columns kept."""
    rows = dedup(set_apart(docs), length, "_doc_id", "_text", carry=("_row",))
    return rewritten(rows, docs.columns, "kept")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return dedup(docs, length, with_text=False).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256")
    )
