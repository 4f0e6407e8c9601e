"""Counts over the texts of an Arrow batch, the same as the column expressions of `text.py` find one text at a time.

Patterns without escapes, repetitions and anchors mean the same to every engine, so they are counted by Arrow's automaton, which
reads a text once whatever the number of alternatives. Words are cut by a table of bytes over all texts of a portion.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.functions.lexicon import joined

PLAIN = re.compile(r"(?:[A-Za-z0-9 ',-]|\(\?:|\)|\||\?|\[[A-Za-z0-9 ',-]+\])+")
# These four letters equal an ASCII one when case is ignored.
FOLDS = dict(zip("İıſK", "iisk"))
IN_WORD = np.isin(np.arange(256), list((string.ascii_letters + "'").encode()))
PORTION = 512                                   # texts whose words are held at once


def is_plain(patterns: Sequence[str]) -> bool:
    """Whether every engine finds the same matches of these patterns, none of them empty."""
    one = joined(tuple(patterns))
    return bool(PLAIN.fullmatch(one)) and not re.search(one, "")


def folded(texts: pa.Array) -> pa.Array:
    """The texts with letters that equal an ASCII one replaced by it."""
    held = texts.buffers()[2]
    raw = held.to_pybytes() if held else b""
    for odd, plain in FOLDS.items():
        if odd.encode() in raw:
            texts = pc.replace_substring(texts, odd, plain)
    return texts


def matches(texts: pa.Array, patterns: Sequence[str]) -> pa.Array:
    """Non-overlapping, case-blind matches of any of the plain patterns in folded texts."""
    return pc.count_substring_regex(texts, joined(tuple(patterns)), ignore_case=True)


def has_any(texts: pa.Array, patterns: Sequence[str]) -> pa.Array:
    return pc.match_substring_regex(texts, joined(tuple(patterns)), ignore_case=True)


def portions(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    for i in range(0, len(columns[0]), PORTION):
        yield [c.slice(i, PORTION) for c in columns]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of [a-zA-Z'] in order, and the number of them in each text."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    ends -= ends[0]
    inside = IN_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    begins[first] = inside[first]                # a word does not go on in the next text
    at = np.flatnonzero(begins)
    kept = raw[inside]
    starts = np.append((np.cumsum(inside) - 1)[at], len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(kept))
    return found, np.diff(np.searchsorted(at, ends))


def word_counts(lowered: pa.Array, stop_words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and stop words of each text."""
    counts, stops = [], []
    for part, in portions(lowered):
        found, n = words(part)
        counts.append(n)
        stopped = np.asarray(pc.is_in(found, pa.array(stop_words, pa.string())).cast(pa.int8()))
        stops.append(np.bincount(np.repeat(np.arange(len(n)), n), weights=stopped, minlength=len(n)).astype(np.int64))
    return np.concatenate(counts), np.concatenate(stops)


def valence_sums(lowered: pa.Array, valences: Mapping[str, float], negators: Sequence[str], negated: float, reach: int) -> np.ndarray:
    """Total, positive part, negative part and number of neutral words of each text, as rows of one matrix."""
    known, weight = pa.array(list(valences), pa.string()), np.array([*map(float, valences.values()), 0.0])
    sums = []
    for part, in portions(lowered):
        found, n = words(part)
        row = np.repeat(np.arange(len(n)), n)
        value = weight[np.asarray(pc.index_in(found, known).fill_null(-1))]
        flips = np.asarray(pc.is_in(found, pa.array(negators, pa.string())).cast(pa.int8())).astype(bool)
        at = np.flatnonzero(value)
        flipped = np.zeros(len(at), bool)
        for back in range(1, reach + 1):
            before = np.maximum(at - back, 0)
            flipped |= (at >= back) & flips[before] & (row[before] == row[at])
        v = value[at] * np.where(flipped, negated, 1.0)

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(row[at], weights=x, minlength=len(n))
        sums.append(np.stack([total(v), total(np.where(v > 0, v + 1, 0.0)), total(np.where(v < 0, v - 1, 0.0)),
                              n - total((v != 0).astype(float))]))
    return np.concatenate(sums, axis=1)
