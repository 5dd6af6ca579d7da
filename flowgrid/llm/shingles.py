"""Word shingles of whole texts as weighted sets of 64-bit hashes, and their similarity."""

from __future__ import annotations

import numpy as np

WORDS = 5
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 20
#: Bytes of short texts that are hashed together.
_TOGETHER = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIERS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits (SplitMix64's end)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_P, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(_P_INVERSE, k, 1 << 64))])


def _hash_words(b: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and end of each word; hashes don't depend on where a word stands."""
    n = len(b)
    _Powers.grow(n + 1)
    turns = np.flatnonzero(np.diff(np.concatenate(([True], gap[b], [True])).view(np.int8)))
    starts, ends = turns[0::2], turns[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * _Powers.down[:n])))
    return mix((sums[ends] - sums[starts]) * _Powers.up[starts]), ends


def word_hashes(text: str | bytes, gap: np.ndarray = _SPACE, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the whole text, in order.

    ``gap`` says of other bytes that they separate words; ``fold`` replaces each byte first.
    """
    b = np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8)
    if fold is not None:
        b = fold[b]
    if len(b) <= _CHUNK:
        return _hash_words(b, gap)[0]
    out, at = [], 0
    while at < len(b):
        part = b[at : at + _CHUNK]
        if at + len(part) < len(b):
            cut = np.flatnonzero(gap[part])
            size = _CHUNK
            while not len(cut) and at + size < len(b):  # a word longer than the chunk
                size *= 2
                part = b[at : at + size]
                cut = np.flatnonzero(gap[part])
            if at + len(part) < len(b):
                part = part[: cut[-1] + 1]
        out.append(_hash_words(part, gap)[0])
        at += len(part)
    return np.concatenate(out)


def word_bounds(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a UTF-8 text starts and ends."""
    turns = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[np.frombuffer(b, np.uint8)], [True])).view(np.int8)))
    return turns[0::2], turns[1::2]


def shingle_stream(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The hash of every run of ``size`` words, in order; of all words if there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = total + words[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return mix(total)


def shingle_streams(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """``shingle_stream(word_hashes(text), size)`` of each UTF-8 text; short texts are hashed together."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) < _TOGETHER:
            held += len(texts[to]) + 1
            to += 1
        if held > _CHUNK:
            out.append(shingle_stream(word_hashes(texts[at]), size))
        else:
            words, ends = _hash_words(np.frombuffer(b" ".join(texts[at:to]), np.uint8), _SPACE)
            # Shingles over the end of a text are skipped.
            every = shingle_stream(words, size)
            last = np.cumsum([len(t) + 1 for t in texts[at:to]]) - 1
            lo = 0
            for hi in np.searchsorted(ends, last, side="right").tolist():
                out.append(every[lo : hi - size + 1] if hi - lo >= size else shingle_stream(words[lo:hi], size))
                lo = hi
        at = to
    return out


def weighted_shingles(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, and how often each occurs."""
    return np.unique(shingle_stream(word_hashes(text), size), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard similarity of the sets, and probability Jaccard similarity of the weighted sets.

    The latter is the sum over common d of 1 / sum_e max(x_e / x_d, y_e / y_d). In the order of
    x / y a prefix takes its maximum from x and the rest from y, so sorted sums give it at once.
    """
    ha, wa = a
    hb, wb = b
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    both = np.intersect1d(ha, hb, assume_unique=True)
    union = len(ha) + len(hb) - len(both)
    plain = len(both) / union
    if wa.max() == 1 and wb.max() == 1:
        return plain, plain
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)] = wa
    y[np.searchsorted(every, hb)] = wb
    with np.errstate(divide="ignore"):
        order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    from_x = np.cumsum(x)
    from_y = y.sum() - np.cumsum(y)
    common = (x > 0) & (y > 0)
    return plain, float((1.0 / (from_x[common] / x[common] + from_y[common] / y[common])).sum())
