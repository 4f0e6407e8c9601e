"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidemark.llm.fingerprint import mix

_RNG = np.random.default_rng(20240229)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
EXACT = _RNG.integers(1, 2 ** 63, 256, np.uint64) | np.uint64(1)
EXACT[SPACE] = 0
FOLDED = EXACT.copy()                           # A-Z count as a-z
FOLDED[65:91] = FOLDED[97:123]
BASE = 0x9E3779B97F4A7C15
PLACES = [np.uint64(k | 1) for k in _RNG.integers(1, 2 ** 63, 64, np.uint64).tolist()]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, up to n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(BASE, -1, 2 ** 64)
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (BASE, inverse)]
    return _POWERS


def word_places(texts: list[bytes], values: np.ndarray = EXACT, white: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hashes of the words of all texts in order, the number of words of each text, and where each
    word starts and ends in the texts joined by spaces (the last result). `white` bytes have the value 0."""
    whole = b" ".join(texts) + b" "
    buf = np.frombuffer(whole, np.uint8)
    space = white[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]       # the text ends with a space
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    borders = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.diff(np.searchsorted(starts, borders))
    power, inverse = _powers(len(buf))
    total = np.cumsum(values[buf] * power[:len(buf)])
    before = np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else total[:0]
    sums = (total[ends - 1] - before) * inverse[starts]
    return mix(sums + (ends - starts).astype(np.uint64)), counts, starts, ends, whole


def word_hashes(texts: list[bytes], values: np.ndarray = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text."""
    return word_places(texts, values)[:2]


def shingles(texts: list[bytes], size: int, values: np.ndarray = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, in order, and their number per text.

    A text with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    words, counts = word_hashes(texts, values)
    starts = np.cumsum(counts) - counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    full = np.where(counts >= size, counts - size + 1, 0)
    out = np.empty(int(made.sum()), np.uint64)
    at = np.cumsum(made) - made
    if full.any():
        first = np.repeat(starts - (np.cumsum(full) - full), full) + np.arange(int(full.sum()))
        sums = np.zeros(len(first), np.uint64)
        for k in range(size):
            sums += words[first + k] * PLACES[k]
        out[np.repeat(at - (np.cumsum(full) - full), full) + np.arange(len(first))] = mix(sums)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[starts[i]:starts[i] + counts[i]]
        whole = sum(int(w) * int(p) for w, p in zip(own, PLACES)) + len(own)
        out[at[i]] = mix(np.array([whole % 2 ** 64], np.uint64))[0]
    return out, made


def portions(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
