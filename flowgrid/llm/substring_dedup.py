"""Near-duplicate passages by compact windows.

Tokens are five-word shingles. Under each of a few hash functions every token sequence of at least
the passage's length has one minimum; sequences that share it form a compact window (l, c, r): all
those within l..r that contain c. Windows come from the Cartesian tree of the hashes. A window goes
under two keys: its minimum with the token ``BESIDE`` places after it, and with the one before it.
Similar passages have a run in common that holds one of the two, while a short line that many
documents share has neither. Windows of two documents with one key collide; where windows of enough
hash functions collide over common intervals, the passages are fetched and verified.
"""

from __future__ import annotations

import itertools
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.llm.bpe import slices
from flowgrid.llm.common import discard, materialise, only_with
from flowgrid.llm.components import connected_components
from flowgrid.llm.shingles import WORDS, mix, shingle_streams, word_bounds
from flowgrid.operators.encode import small

#: Hash functions, and how many of them must collide over common intervals.
HASHES = 4
ENOUGH = 2
#: Places from a minimum to the tokens that complete its keys.
BESIDE = 9
#: Least words of a passage, and least similarity.
PASSAGE = 50
THRESHOLD = 0.8
#: Classes under a key up to which all of them meet, and documents up to which a shingle lists its pairs.
LARGE = 32

_BLOCK = 1 << 23


def _least_of_runs(hashes: np.ndarray, least: int) -> np.ndarray:
    """Least value, with its place in the lower 24 bits, of every run of ``least`` tokens, by doubling."""
    n = len(hashes)
    low = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: n - least + 1], low[least - width :])


def compact_windows(hashes: np.ndarray, documents: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``least`` tokens, r inclusive.

    ``hashes`` are the tokens' values under one function, documents after each other;
    ``documents`` numbers each token's document and ``ends`` has the documents' ends. Equal minima
    go to the first.
    """
    n = len(hashes)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    low = _least_of_runs(hashes, least)
    low = low[documents[: n - least + 1] == documents[least - 1 :]]
    if not len(low):
        return (np.zeros(0, np.int64),) * 3
    # A window is wide enough exactly if its minimum is that of some run.
    low = low[np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))]
    c = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    # The Cartesian tree over these minima: what bounds a wide window is the minimum of a wide one.
    starts, doc = np.concatenate(([0], ends[:-1])), documents[c]
    return _bounds(low, c, doc, starts, 1) + 1, c, _bounds(low[::-1], c[::-1], doc[::-1], ends - 1, -1)[::-1] - 1


def _bounds(value: np.ndarray, place: np.ndarray, doc: np.ndarray, first: np.ndarray, step: int) -> np.ndarray:
    """Place of the nearest smaller value that stands before each value in its document, or the one
    beside the document's ``first`` place. All look at once, from what they have seen to what that has."""
    n = len(value)
    new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    near = np.arange(-1, n - 1)
    # A document's first value sees nothing, and no other one looks past a value that sees nothing.
    near[new] = n
    value = np.append(value, np.uint64(0))
    near = np.append(near, n)
    left = np.flatnonzero(value[near] > value)
    while len(left):
        seen = near[near[left]]
        near[left] = seen
        left = left[value[seen] > value[left]]
    near = near[:n]
    return np.where(near < n, place[np.minimum(near, n - 1)], first[doc] - step)


_WINDOW = T.StructType([T.StructField(k, T.LongType()) for k in ("key", "doc", "place")])
_SPAN = (1 << 26) - 1


def _placed(l: np.ndarray, r: np.ndarray, f: int) -> np.ndarray:
    """A window's first token, its length and function in one number that sorts by the first token."""
    return l << 30 | np.minimum(r - l, _SPAN) << 4 | f


def _unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, r, f) of places."""
    l = place >> 30
    return l, l + (place >> 4 & _SPAN), place & 15


def _merged(key: np.ndarray, doc: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """One document's windows under one key that overlap, as one window."""
    order = np.lexsort((l, doc, key))
    key, doc, l, r = key[order], doc[order], l[order], r[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (l[1:] > r[:-1])))
    at = np.flatnonzero(new)
    return key[at], doc[at], l[at], np.maximum.reduceat(r, at)


def windows_of(docs: DataFrame, doc_id: str, text: str, hashes: int = HASHES, passage: int = PASSAGE) -> DataFrame:
    """(key, doc, place) of the compact windows of every whole text, in places of shingles. A text of
    many millions of words is cut into overlapping blocks."""
    least = passage - WORDS + 1

    def found(ids: list[int], streams: list[np.ndarray], offsets: list[int]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(streams)
        lengths = np.array([len(s) for s in streams])
        ends = np.cumsum(lengths)
        documents = np.repeat(np.arange(len(streams)), lengths)
        base, shift, names = ends - lengths, np.array(offsets), np.array(ids, np.int64)
        for f in range(hashes):
            values = mix(tokens + np.uint64((f + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            left, c, right = compact_windows(values, documents, ends, least)
            for k, beside in enumerate((c + BESIDE, c - BESIDE)):
                inside = np.flatnonzero((beside >= left) & (beside <= right))
                if not len(inside):
                    continue
                own = documents[c[inside]]
                move = shift[own] - base[own]
                keys = mix(values[c[inside]] * np.uint64(0xD1342543DE82EF95) + tokens[beside[inside]] + np.uint64(k)).view(np.int64)
                key, doc, l, r = _merged(keys, names[own], left[inside] + move, right[inside] + move)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, _placed(l, r, f))], names=_WINDOW.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _streams(batches, least):
            yield from found(*group)

    return _long_enough(docs, doc_id, text, passage).mapInArrow(run, _WINDOW)


def _long_enough(docs: DataFrame, doc_id: str, text: str, passage: int) -> DataFrame:
    """(doc, text) of the texts that may have so many words."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return given.filter(F.col("doc").isNotNull() & (F.length("text") >= 2 * passage - 1))


def _hashed(texts: pa.Array) -> list[np.ndarray]:
    """The shingles of each text; null has none."""
    return shingle_streams([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()])


def _streams(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[int], list[np.ndarray], list[int]]]:
    """Some texts' documents, shingles and places of the first shingle at a time."""
    for batch in batches:
        for small in slices(batch, 256):
            ids, streams, offsets, size = [], [], [], 0
            for doc, stream in zip(small.column(0).to_pylist(), _hashed(small.column(1)), strict=True):
                for at in range(0, max(1, len(stream) - least + 1), _BLOCK):
                    part = stream[at : at + _BLOCK + least - 1]
                    if len(part) < least:
                        continue
                    if size + len(part) >= 1 << 24:
                        yield ids, streams, offsets
                        ids, streams, offsets, size = [], [], [], 0
                    ids.append(doc)
                    streams.append(part)
                    offsets.append(at)
                    size += len(part)
            if streams:
                yield ids, streams, offsets


_SHARED = T.StructType([T.StructField(k, T.LongType()) for k in ("key", "doc", "place", "lead", "lead_place")])


def _shared(windows: DataFrame) -> DataFrame:
    """The windows whose key several documents hold, each with the first window of the key's least
    document; that document's own have the first one of the next document. Keys pass in order, so a
    task keeps no more than one document's windows under one key, however many documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # windows of the last key, as long as one document has it
        now = None  # of the last key, once several documents have it: key, lead, its first place
        for batch in batches:
            key, doc, place = (np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True))
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.concatenate((start[1:], [len(key)]))
            lead, first = doc[start].copy(), place[start].copy()
            several = doc[end - 1] != lead
            if now is not None and now[0] == key[0]:
                lead[0], first[0], several[0] = now[1], now[2], True
            now = (key[-1], lead[-1], first[-1]) if several[-1] else None
            of = np.repeat(np.arange(len(start)), end - start)
            held = [np.zeros(0, np.int64)] * 3 if several[-1] else [x[start[-1] :] for x in (key, doc, place)]
            keep = np.flatnonzero(several[of])
            key, doc, place, of = key[keep], doc[keep], place[keep], of[keep]
            lead, first = lead[of], first[of]
            own = np.flatnonzero(doc == lead)
            if len(own):  # the next document's first window
                after = np.searchsorted(of[own], of[own], side="right") - np.searchsorted(of[own], of[own], side="left")
                nexts = np.searchsorted(of, of[own], side="left") + after
                lead[own], first[own] = doc[nexts], place[nexts]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, place, lead, first)], names=_SHARED.names)

    dealt = windows.repartition("key").sortWithinPartitions("key", "doc", "place")
    return dealt.mapInArrow(run, _SHARED)


def common_intervals(rows: list[tuple[int, int, int, int, int]], enough: int = ENOUGH) -> list[tuple[int, int, int, int]]:
    """(a0, a1, b0, b1), inclusive, over which windows of ``enough`` functions collide.

    Each row (la, ra, lb, rb, f) has two windows and their function; rows ascend. The interval join
    sweeps over the first document; collisions belong together if they overlap in both documents.
    """
    open_: list[tuple] = []
    done: list[tuple] = []
    for la, ra, lb, rb, f in rows:
        still, functions = [], 1 << f
        l0, r0 = lb, rb
        for o in open_:
            if o[1] < la:
                done.append(o)
            elif o[2] <= r0 and l0 <= o[3]:
                la, ra, l0, r0, functions = min(o[0], la), max(o[1], ra), min(o[2], l0), max(o[3], r0), functions | o[4]
            else:
                still.append(o)
        open_ = [*still, (la, ra, l0, r0, functions)]
    return [o[:4] for o in done + open_ if o[4].bit_count() >= enough]


def _longest(starts: list[int], ends: list[int], other_starts: list[int], other_ends: list[int], costs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges i..k of segments, inclusive, whose hits make up for the costs of the gaps between them
    and that have ``least`` on both sides: the longest, then the longest beside it, and so on."""
    sizes = np.array(ends) - np.array(starts)
    after = np.cumsum(sizes - costs)
    before = (after - sizes).tolist()
    after = after.tolist()
    out, parts = [], [(0, len(starts))]
    while parts:
        lo, hi = parts.pop()
        if lo >= hi or min(ends[hi - 1] - starts[lo], other_ends[hi - 1] - other_starts[lo]) < least:
            continue
        # The first of each new low can't be bettered as a start; ends are tried from the last.
        lows = [lo]
        for k in range(lo + 1, hi):
            if before[k] < before[lows[-1]]:
                lows.append(k)
        best = (0, lo, lo)
        for k in range(hi - 1, lo - 1, -1):
            while lows and after[k] >= before[lows[-1]] - 1e-6:
                i = lows.pop()
                if i <= k:
                    best = max(best, (min(ends[k] - starts[i], other_ends[k] - other_starts[i]), i, k))
            if not lows:
                break
        size, i, k = best
        if size >= least:
            out.append((i, k))
            parts += [(lo, i), (k + 1, hi)]
    return sorted(out)


def _dense_runs(hit: np.ndarray, against: float, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least``, from hit to hit, in which hits at 1 make up for misses at
    -against: the longest, then the longest on either side of it, and so on."""
    if np.count_nonzero(hit) < against / (1 + against) * least - 1e-6:
        return []
    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    if not len(turns):
        return []
    starts, ends = turns[0::2], turns[1::2]
    gaps = np.concatenate(([0], starts[1:] - ends[:-1]))
    start, end = starts.tolist(), ends.tolist()
    return [(start[i], end[k]) for i, k in _longest(start, end, start, end, against * gaps, least)]


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of both as numbers from 0 on, equal ones with equal numbers."""
    every = np.concatenate((a, b))
    order = np.argsort(every)
    ranked = every[order]
    numbers = np.empty(len(every), np.int64)
    numbers[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))[: len(every)]
    return numbers[: len(a)], numbers[len(a) :]


def _aligned(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal numbers below ``size``, ascending in both: a longest chain of those that each
    side has once, and the equal neighbours of its links."""
    place = np.zeros(size, np.int64)
    place[b] = np.arange(len(b))
    pa_ = np.flatnonzero((np.bincount(a, minlength=size)[a] == 1) & (np.bincount(b, minlength=size)[a] == 1))
    pb_ = place[a[pa_]]
    if len(pb_) > 1 and (np.diff(pb_) < 0).any():
        tails, at, back = [], [], []
        for k, v in enumerate(pb_.tolist()):
            i = bisect_left(tails, v)
            back.append(at[i - 1] if i else -1)
            tails[i : i + 1], at[i : i + 1] = [v], [k]
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(k)
            k = back[k]
        pa_, pb_ = pa_[chain[::-1]], pb_[chain[::-1]]
    if not len(pa_) or len(pa_) == min(len(a), len(b)):
        return pa_, pb_
    # Repeated shingles beside a link: forwards to the next link, then backwards to what is taken.
    breaks = np.flatnonzero((np.diff(pa_) != 1) | (np.diff(pb_) != 1)) + 1
    edges = [0, *breaks.tolist(), len(pa_)]
    xs, ys, x, y = [], [], -1, -1
    for lo, hi in itertools.pairwise(edges):
        i, j = int(pa_[lo]), int(pb_[lo])
        n = 0
        while i - n - 1 > x and j - n - 1 > y and a[i - n - 1] == b[j - n - 1]:
            n += 1
        to_x, to_y = (pa_[hi], pb_[hi]) if hi < len(pa_) else (len(a), len(b))
        x, y = int(pa_[hi - 1]), int(pb_[hi - 1])
        while x + 1 < to_x and y + 1 < to_y and a[x + 1] == b[y + 1]:
            x, y = x + 1, y + 1
        xs.append(np.arange(i - n, x + 1))
        ys.append(np.arange(j - n, y + 1))
    return np.concatenate(xs), np.concatenate(ys)


def _similarity(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Jaccard similarity of two sets of numbers below ``size``."""
    mine, other = np.zeros(size, bool), np.zeros(size, bool)
    mine[a] = True
    other[b] = True
    return float(np.count_nonzero(mine & other) / np.count_nonzero(mine | other))


def verify(a: np.ndarray, b: np.ndarray, least: int, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """Passages (a0, a1, b0, b1, similarity) of two shingle sequences, ends exclusive.

    Both are aligned. Of two aligned passages the misses of either side stand in the union once, so
    hits at 1 and misses at threshold / (1 - threshold) give just the runs of that similarity. What
    stands in another order or repeats is looked for without the alignment: a run of shingles that
    the second holds, and the longest such run of the second. A run that fails is tried again in
    parts that are denser. The sets' Jaccard similarity decides about all of them.
    """
    out = []
    if min(len(a), len(b)) < least:
        return out
    if len(a) == len(b) and (a == b).all():
        ranked = np.sort(a)
        new = np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))
        if (new[1:] & new[:-1]).any():  # equal sequences with a shingle that links them are one passage
            return [(0, len(a), 0, len(b), 1.0)]
    against = threshold / (1 - threshold)
    # Hits make up for misses in every passage, on either side, whatever its order. The lower bits of
    # the shingles show all hits, and perhaps some more.
    for one, other in ((a, b), (b, a)):
        seen = np.zeros(1 << 16, bool)
        seen[other.astype(np.uint16)] = True
        hit = seen[one.astype(np.uint16)]
        if np.count_nonzero(hit) < threshold * len(one) and not _dense_runs(hit, against, least):
            return out
    a, b = _numbered(a, b)
    size = int(max(a.max(), b.max())) + 1
    left = np.bincount(b, minlength=size)[a] > 0
    xs, ys = _aligned(a, b, size)
    if len(xs):
        breaks = np.flatnonzero((np.diff(xs) != 1) | (np.diff(ys) != 1)) + 1
        first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(xs)])) - 1
        sa, ea, sb, eb = xs[first], xs[last] + 1, ys[first], ys[last] + 1
        gaps = np.concatenate(([0], sa[1:] - ea[:-1] + sb[1:] - eb[:-1]))
        sa, ea, sb, eb = (x.tolist() for x in (sa, ea, sb, eb))
        for i, k in _longest(sa, ea, sb, eb, against * gaps, least):
            similar = _similarity(a[sa[i] : ea[k]], b[sb[i] : eb[k]], size)
            if similar >= threshold:
                out.append((sa[i], ea[k], sb[i], eb[k], similar))
    for x, y, *_ in out:
        left[x:y] = False
    open_ = [(x, y, against) for x, y in _dense_runs(left, against, least)]
    while open_:
        x, y, strict = open_.pop()
        mine = np.zeros(size, bool)
        mine[a[x:y]] = True
        hit = mine[b]
        both = np.zeros(size, bool)
        both[b[hit]] = True
        best, similar, weight = (), 0.0, against
        # All of b has no more of these shingles than any part of it.
        possible = np.count_nonzero(both) >= threshold * np.count_nonzero(mine) - 1e-6
        while possible and similar < threshold and weight <= 32 * against:
            runs = _dense_runs(hit, weight, least)
            if not runs:  # nor are there denser ones
                break
            for u, v in runs:
                now = _similarity(a[x:y], b[u:v], size)
                if now > similar:
                    best, similar = (u, v), now
            weight *= 2
        if similar >= threshold:
            out.append((x, y, *best, similar))
        elif strict < 32 * against:
            open_ += [(x + u, x + v, 2 * strict) for u, v in _dense_runs(left[x:y], 2 * strict, least)]
    return out


def _spans(meets: DataFrame, enough: int) -> DataFrame:
    """(a, b, a0, a1, b0, b1) where windows of the meetings (a, pa, b, pb) have enough functions in common."""
    span = T.StructType([T.StructField(k, T.LongType()) for k in ("a", "b", "a0", "a1", "b0", "b1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in itertools.chain(batches, (None,)):
            columns = held if batch is None else [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            a, b, pa_, pb = columns
            if not len(a):
                continue
            start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            end = np.concatenate((start[1:], [len(a)]))
            if batch is not None:  # the last pair may go on
                held = [x[start[-1] :] for x in columns]
                start, end = start[:-1], end[:-1]
            large = np.flatnonzero(end - start >= enough)
            (la, ra, f), (lb, rb, _) = _unplaced(pa_), _unplaced(pb)
            rows = list(zip(*[x.tolist() for x in (la, ra, lb, rb, f)], strict=True))
            out = [(k, *x) for k, i, j in zip(large.tolist(), start[large].tolist(), end[large].tolist(), strict=True) for x in common_intervals(rows[i:j], enough)]
            if out:
                at = start[np.array([x[0] for x in out])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a[at], b[at], *zip(*[x[1:] for x in out], strict=True))], names=span.names)

    return meets.select("a", "b", "pa", "pb").repartition("a", "b").sortWithinPartitions("a", "b", "pa").mapInArrow(run, span)


def _compared(meets: DataFrame, docs: DataFrame, doc_id: str, text: str, passage: int, threshold: float, enough: int) -> DataFrame:
    """The verified passages of the meetings (a, pa, b, pb)."""
    least = passage - WORDS + 1
    spans = materialise(_spans(meets, enough), "spans")
    # The passages' words, fetched from the texts side by side and compressed.
    sides = [spans.select(F.col(k).alias("doc"), F.col(f"{k}0").alias("from"), F.col(f"{k}1").alias("to")) for k in "ab"]
    asked = sides[0].unionByName(sides[1]).groupBy("doc").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    asked = materialise(asked, "asked", reduced=True)
    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    cut = T.StructType([*[T.StructField(k, T.LongType()) for k in ("doc", "from", "to")], T.StructField("s", T.BinaryType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, 64):
                rows = []
                for doc, t, places in zip(small.column(0).to_pylist(), small.column(1), small.column(2).to_pylist(), strict=True):
                    b = (t.as_py() or "").encode()
                    starts, ends = word_bounds(b)
                    rows += [(doc, p["from"], p["to"], zlib.compress(b[starts[p["from"]] : ends[min(p["to"] + WORDS, len(ends)) - 1]], 1)) for p in places if p["from"] < len(starts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=cut.names)

    pieces = materialise(only_with(given, "doc", asked).join(asked, "doc").select("doc", "text", "spans").mapInArrow(fetch, cut), "pieces")
    sides = [pieces.select(F.col("doc").alias(k), F.col("from").alias(f"{k}0"), F.col("to").alias(f"{k}1"), F.col("s").alias(f"s{k}")) for k in "ab"]
    both = spans.join(sides[0], ["a", "a0", "a1"]).join(sides[1], ["b", "b0", "b1"]).select("a", "b", "a0", "b0", "sa", "sb")
    out = T.StructType([T.StructField(k, T.LongType()) for k in ("a", "a_start", "a_words", "b", "b_start", "b_words")] + [T.StructField("similarity", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, 64):
                rows, columns = [], [c.to_pylist() for c in small.columns]
                packed = list(dict.fromkeys(columns[4] + columns[5]))
                of = dict(zip(packed, shingle_streams([zlib.decompress(x) for x in packed]), strict=True))
                for a, b, a0, b0, sa, sb in zip(*columns, strict=True):
                    for x, y, u, v, similar in verify(of[sa], of[sb], least, threshold):
                        rows.append((a, a0 + x, y - x + WORDS - 1, b, b0 + u, v - u + WORDS - 1, similar))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int64()] * 6 + [pa.float64()], strict=True)], names=out.names)

    passages = materialise(both.mapInArrow(judge, out).distinct(), "passages")
    discard(spans, asked, pieces)
    return passages


def _run_hashes(stream: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` shingles, by doubling; equal runs have equal ones
    wherever they stand."""
    n = len(stream) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, width = stream, 1
    while 2 * width <= size:
        out = mix(out[:-width] * _RUN + out[width:])
        width *= 2
    return mix(out[:n] * _RUN + out[size - width :])


_RUN = np.uint64(0xD1342543DE82EF95)
_CONTEXT = T.StructType([T.StructField(k, T.LongType()) for k in ("context", "left", "right", "doc", "p", "n")])


def _contexts(docs: DataFrame, doc_id: str, text: str, passage: int) -> DataFrame:
    """(context, left, right, doc, p, n): each text's runs of ``passage`` words, which start at p up to
    p + n - 1, together where one shingle is the least of them all.

    ``context`` is the hash of what these runs span, ``left`` and ``right`` of the half run that ends
    or begins with that shingle, null if none of the runs holds it. Equal runs have equal least
    shingles at one place in them and hold at least one of the halves.
    """
    size = passage - WORDS + 1
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, streams, offsets in _streams(batches, size):
            tokens, lengths = np.concatenate(streams), np.array([len(s) for s in streams])
            documents, ends = np.repeat(np.arange(len(streams)), lengths), np.cumsum(lengths)
            low = _least_of_runs(mix(tokens + _RUN), size)
            place = np.flatnonzero(documents[: len(low)] == documents[size - 1 :])
            c = (low[place] & np.uint64((1 << 24) - 1)).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            c, first, last = c[new], place[new], place[np.concatenate((new[1:], [len(c)])) - 1]
            runs, halves = _run_hashes(tokens, size), _run_hashes(tokens, half)
            context = mix(runs[first] * _RUN + runs[last] + (last - first).astype(np.uint64))
            before, after = c - half + 1, np.minimum(c, len(halves) - 1)
            left, right = halves[np.maximum(before, 0)], mix(halves[after] + _RUN)
            own = documents[first]
            p = first + (np.array(offsets) - ends + lengths)[own]
            columns = [pa.array(context.view(np.int64)), pa.array(left.view(np.int64), mask=before < first), pa.array(right.view(np.int64), mask=c + half > last + size)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x) for x in (np.array(ids, np.int64)[own], p, last - first + 1)]], names=_CONTEXT.names)

    return _long_enough(docs, doc_id, text, passage).mapInArrow(run, _CONTEXT)


def _held(rows: DataFrame, by: str, *more: Column) -> DataFrame:
    """Each group's first and last (doc, p)."""
    at = F.struct("doc", "p")
    return rows.groupBy(by).agg(F.min(at).alias("lead"), F.max(at).alias("hi"), *more)


def _linked(rows: DataFrame) -> DataFrame:
    """Links (a, pa, b, pb, n) of rows (doc, p, n, lead, hi) with the first document of their group; other
    places of that document with the last one."""
    own = F.col("doc") == F.col("lead.doc")
    rows = rows.filter((F.col("lead.doc") < F.col("hi.doc")) & (~own | (F.col("p") != F.col("lead.p"))))
    return rows.select(*[F.when(own, F.col(x)).otherwise(F.col(y)).alias(k) for k, x, y in (("a", "doc", "lead.doc"), ("pa", "p", "lead.p"), ("b", "hi.doc", "doc"), ("pb", "hi.p", "p"))], "n")


def _exact_passages(docs: DataFrame, doc_id: str, text: str, found: DataFrame, passage: int) -> DataFrame:
    """Passages of ``passage`` words or more that documents share exactly, verified by their words'
    hashes, but for those that are part of what ``found`` has of the same two documents: (a, a_start,
    a_words, b, b_start, b_words, similarity).

    Equal contexts become one: each meets the first of them. Of contexts that differ, but have
    half a run in common, the first ones' runs are compared by value, each with the least document
    that holds it. So no pairs of the others are made. What overlaps along one shift is one passage.
    """
    size = passage - WORDS + 1
    every = materialise(_contexts(docs, doc_id, text, passage), "contexts")
    groups = materialise(_held(every, "context", F.first("left").alias("left"), F.first("right").alias("right")), "groups")
    halves = groups.select("context", F.explode(F.array_compact(F.array("left", "right"))).alias("half"))
    several = materialise(halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"), "halves", reduced=True)
    partly = materialise(only_with(halves, "half", several).join(several, "half").select("context").distinct(), "partly", reduced=True)
    shared = F.col("lead.doc") < F.col("hi.doc")
    wanted = groups.filter(shared).unionByName(only_with(groups.filter(~shared), "context", partly)).select("context", "lead", "hi")
    wanted = wanted.join(partly.withColumn("partly", F.lit(True)), "context", "left").filter(shared | F.col("partly"))
    wanted = materialise(wanted, "wanted", reduced=True)
    rows = materialise(only_with(every, "context", wanted).join(wanted, "context").select("doc", "p", "n", "lead", "hi", "partly"), "rows", reduced=True)
    discard(every, groups, several, partly, wanted)
    asked = rows.filter(F.col("partly") & ((F.col("lead.doc") == F.col("hi.doc")) | (F.struct("doc", "p") == F.col("lead"))))
    asked = materialise(asked.groupBy("doc").agg(F.collect_list(F.struct("p", "n")).alias("spans")), "spans", reduced=True)
    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    out = T.StructType([T.StructField(k, T.LongType()) for k in ("run", "doc", "p")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, 64):
                columns: list[list[np.ndarray]] = [[], [], []]
                for doc, stream, spans in zip(small.column(0).to_pylist(), _hashed(small.column(1)), small.column(2).to_pylist(), strict=True):
                    hashes = _run_hashes(stream, size).view(np.int64)
                    # Rows that share an id have the places of one another.
                    places = np.concatenate([np.arange(x["p"], min(x["p"] + x["n"], len(hashes))) for x in spans])
                    columns[0].append(hashes[places])
                    columns[1].append(np.full(len(places), doc))
                    columns[2].append(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns], names=out.names)

    runs = materialise(only_with(given, "doc", asked).join(asked, "doc").select("doc", "text", "spans").mapInArrow(run, out), "runs")
    held = materialise(_held(runs, "run").filter(F.col("lead.doc") < F.col("hi.doc")), "held", reduced=True)
    same = only_with(runs, "run", held).join(held, "run").withColumn("n", F.lit(1).cast("long"))
    met = _linked(rows).unionByName(_linked(same)).withColumns({"shift": F.col("pb") - F.col("pa"), "end": F.col("pa") + F.col("n") + (size - 1)})
    along = Window.partitionBy("a", "b", "shift").orderBy("pa", "end")
    met = met.withColumn("new", F.coalesce(F.col("pa") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("long"))
    met = met.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = met.groupBy("a", "b", "shift", "part").agg(F.min("pa").alias("a_start"), F.max("end").alias("end"))
    words = (F.col("end") - F.col("a_start") + (WORDS - 1)).alias
    exact = merged.select("a", "a_start", words("a_words"), "b", (F.col("a_start") + F.col("shift")).alias("b_start"), words("b_words"), F.lit(1.0).alias("similarity"))
    pairs = found.groupBy("a", "b").agg(F.collect_list(F.struct("a_start", "a_words", "b_start", "b_words")).alias("passages"))
    inside = F.expr("exists(passages, x -> x.a_start <= a_start and a_start + a_words <= x.a_start + x.a_words and x.b_start <= b_start and b_start + b_words <= x.b_start + x.b_words)")
    exact = exact.join(pairs, ["a", "b"], "left").filter(~F.coalesce(inside, F.lit(False))).drop("passages")
    exact = materialise(exact, "exact", reduced=True)
    discard(rows, asked, runs, held)
    return exact


def _hits_needed(passage: int, threshold: float) -> int:
    """Places of a document that a similar passage must share with the other one, at least."""
    return math.ceil(threshold * (passage - WORDS + 1) - 1e-9)


def _tokens(first: DataFrame, large: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, token, n): how often each shingle stands in any window of ``first`` of the documents that have a window
    under a key of ``large``. What is compared of a document later is always part of these windows."""
    wanted = materialise(first.join(small(large), "key", "left_semi").select("doc").distinct(), "wanted", reduced=True)
    asked = materialise(first.join(small(wanted), "doc", "left_semi").groupBy("doc").agg(F.collect_set("place").alias("places")), "asked", reduced=True)
    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    out = T.StructType([T.StructField(k, T.LongType()) for k in ("doc", "token", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                columns: list[list[np.ndarray]] = [[], [], []]
                for doc, stream, places in zip(part.column(0).to_pylist(), _hashed(part.column(1)), part.column(2), strict=True):
                    l, r, _ = _unplaced(places.values.to_numpy(zero_copy_only=False))
                    steps = np.zeros(len(stream) + 1, np.int64)
                    np.add.at(steps, np.minimum(l, len(stream)), 1)
                    np.add.at(steps, np.minimum(r + 1, len(stream)), -1)
                    token, n = np.unique(stream[np.cumsum(steps)[:-1] > 0], return_counts=True)
                    columns[0].append(np.full(len(token), doc))
                    columns[1].append(token.view(np.int64))
                    columns[2].append(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns], names=out.names)

    texts = only_with(given, "doc", asked).join(asked, "doc").select("doc", "text", "places")
    # Rows that share an id are one document.
    tokens = materialise(texts.mapInArrow(run, out).groupBy("doc", "token").agg(F.sum("n").alias("n")), "tokens", reduced=True)
    discard(wanted, asked)
    return tokens


def _possible(tokens: DataFrame, needed: int) -> tuple[DataFrame, DataFrame]:
    """(doc) of documents with ``needed`` places of common shingles, which more than LARGE documents hold, and the
    pairs (a, b), not both of those, that share one of the other shingles. No other pair has ``needed`` places in
    common. A shingle of the second kind makes LARGE rows for each of its documents at most."""
    held = materialise(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "held", reduced=True)
    common, rare = held.filter(F.col("df") > LARGE), held.filter(F.col("df") <= LARGE)
    dense = tokens.join(common.select("token"), "token").groupBy("doc").agg(F.sum("n").alias("n")).filter(F.col("n") >= needed)
    dense = materialise(dense.select("doc"), "dense", reduced=True)
    sharing = tokens.join(rare.select("token"), "token").select("token", "doc")
    sharing = materialise(sharing.join(small(dense.withColumn("dense", F.lit(True))), "doc", "left"), "sharing", reduced=True)
    thin = sharing.filter("dense is null").select("token", F.col("doc").alias("one"))
    two = thin.join(sharing, "token").filter("one < doc or (dense and one > doc)")
    pairs = two.select(F.least("one", "doc").alias("a"), F.greatest("one", "doc").alias("b")).distinct()
    pairs = materialise(pairs, "pairs", reduced=True)
    discard(held, sharing)
    return dense, pairs


def _between_classes(shared: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, passage: int, threshold: float) -> DataFrame:
    """Meetings of the classes of documents that a key's windows are of: the least document of each
    class with that of every other one. Under a key of more than LARGE classes only those meet that
    share enough shingles for a similar passage to be possible, which shingles' lists say."""
    of = shared.select("key", "doc", "place").join(small(classes.select(F.col("node").alias("doc"), "component")), "doc", "left").withColumn("of", F.coalesce("component", "doc"))
    mixed = of.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).filter("lo != hi").select("key")
    mixed = materialise(mixed, "mixed", reduced=True)
    first = of.join(small(mixed), "key").groupBy("key", "of").agg(F.min("doc").alias("doc"), F.min_by("place", "doc").alias("place")).drop("of")
    first = materialise(first, "classes", reduced=True)
    discard(mixed)

    def met(rows: DataFrame) -> DataFrame:
        one, two = (rows.select("key", F.col("doc").alias(k), F.col("place").alias(f"p{k}")) for k in "ab")
        return one.join(two, "key").filter("a < b").select("a", "pa", "b", "pb")

    large = materialise(first.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("key"), "large", reduced=True)
    if large.isEmpty():
        return met(first)
    tokens = _tokens(first, large, docs, doc_id, text)
    dense, pairs = _possible(tokens, _hits_needed(passage, threshold))
    many = materialise(first.join(small(large), "key", "left_semi"), "many", reduced=True)
    sides = [many.select("key", F.col("doc").alias(k), F.col("place").alias(f"p{k}")) for k in "ab"]
    possible = pairs.join(sides[0], "a").join(sides[1], ["b", "key"]).select("a", "pa", "b", "pb")
    out = met(first.join(small(large), "key", "left_anti")).unionByName(met(many.join(small(dense), "doc", "left_semi"))).unionByName(possible)
    out = materialise(out, "meetings", reduced=True)
    discard(first, large, tokens, dense, pairs, many)
    return out


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE, threshold: float = THRESHOLD, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """Passages of at least ``passage`` words that nearly repeat between documents.

    Returns one row for each document and place of such a passage: doc_id, start_word, n_words, then
    the partner that is most like it (other_doc_id, other_start_word, other_n_words, similarity), the
    number of partners that were verified, and class_id, the least document that is linked to this
    one by any passages. A window meets the least document of its key; then, key by key, the classes
    that are still apart meet by their least documents. So a passage that many documents share names
    them all without all their pairs. Exact repeats are complete: all runs of ``passage`` words that
    several documents hold are found by value, whatever the documents' classes are. Null and short texts have no passages; rows without an id take
    no part; rows that share an id are one document. An empty table gives no rows.
    """
    shared = materialise(_shared(windows_of(docs, doc_id, text, hashes, passage)), "shared")
    discard()
    swap = F.col("doc") > F.col("lead")
    meets = shared.select(*[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(k) for k, x, y in (("a", "lead", "doc"), ("pa", "lead_place", "place"), ("b", "doc", "lead"), ("pb", "place", "lead_place"))])
    found = _compared(meets, docs, doc_id, text, passage, threshold, enough)
    classes = connected_components(found)
    more = _compared(_between_classes(shared, classes, docs, doc_id, text, passage, threshold), docs, doc_id, text, passage, threshold, enough)
    discard(shared, classes)
    found = found.unionByName(more)
    exact = _exact_passages(docs, doc_id, text, found, passage)
    found = materialise(found.unionByName(exact).distinct(), "passages")
    discard(more, exact)
    classes = connected_components(found).select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    names = ("doc_id", "start_word", "n_words", "other_doc_id", "other_start_word", "other_n_words")
    sides = [found.select(*[F.col(c).alias(n) for c, n in zip(cs, names, strict=True)], "similarity") for cs in (("a", "a_start", "a_words", "b", "b_start", "b_words"), ("b", "b_start", "b_words", "a", "a_start", "a_words"))]
    best = F.max(F.struct("similarity", (-F.col("other_doc_id")).alias("o"), (-F.col("other_start_word")).alias("s"), F.col("other_n_words").alias("n"))).alias("x")
    each = sides[0].unionByName(sides[1]).groupBy("doc_id", "start_word", "n_words").agg(best, F.count("*").alias("n_partners"))
    each = each.select("doc_id", "start_word", "n_words", (-F.col("x.o")).alias("other_doc_id"), (-F.col("x.s")).alias("other_start_word"), F.col("x.n").alias("other_n_words"), "x.similarity", "n_partners")
    return each.join(classes, "doc_id")
