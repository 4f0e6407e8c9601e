"""Benchmark passages in documents by latent semantic retrieval and sequence checks.

Documents are cut into blocks of `BLOCK` words; a passage is `SPAN` blocks in a row, so every stretch of
(SPAN - 1) * BLOCK words lies in one. Three streams over all documents, none with a shuffle of texts:

1. In how many blocks each word of the benchmark occurs. Words in more than `COMMON` of all blocks
   carry no weight, but each item keeps at least its `AT_LEAST` rarest.
2. Randomised SVD of the TF-IDF passages: with a random matrix O, every task sums A'(A O) over its
   passages A; the sum, with the items as further rows, spans the latent space after a QR step.
3. Passages and items are compared in that space. Where the cosine is `COSINE` or more, and the passage holds
   `RARE` of the item's weight, stretches a little longer than the item are compared by longest common
   subsequence. It is a leak if `SURE` of the item's words are found in order, or `LIKELY` of them
   and `ANSWER` of its answer (its last sentence).
   An item of more than `PART` words, which one passage need not hold, is searched by parts of so many words that overlap by
   half. Passages like one of its parts are only candidates: the stretches around them, as wide as the item allows, are
   joined where they overlap and compared with the whole item. The cosine is then the largest one of a part.

The benchmark is a stated query set: it goes to the tasks in blocks of about `ITEMS` items or parts of long ones, one
search each, so what a task holds is bounded.

Defined results: null or empty texts and items have no leak. Rows that repeat are reported each. Equal
shares go to the earlier stretch. Words are compared in lower case (A-Z) without ASCII punctuation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import byte_list
from tidemark.llm.hashing import FOLDED, SPACE, portions, word_hashes, word_places

BLOCK, SPAN, RANK, ITEMS = 32, 3, 64, 5_000
PART = (SPAN - 1) * BLOCK
COMMON, AT_LEAST, COSINE, RARE = 0.01, 8, 0.4, 0.4
SURE, LIKELY, ANSWER = 0.75, 0.5, 0.6
PARTS = 16                                      # row blocks in which sums of tasks are added up
PLAIN = bytes((32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b) for b in range(128)) + bytes(range(128, 256))
BREAK = SPACE.copy()
BREAK[[b for b in range(128) if PLAIN[b] == 32]] = True
VALUES = np.where(BREAK, np.uint64(0), FOLDED)
FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, start long, n_words long"


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def answer_of(text: bytes) -> list[bytes]:
    """Words of the last sentence, or the last five words if it has fewer than three."""
    sentences = [w for w in map(plain_words, re.split(rb"[.!?]+", text)) if w]
    last = sentences[-1] if sentences else []
    return last if len(last) >= 3 else plain_words(text)[-5:]


def lcs(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, all columns at once in the bits of one number."""
    full = (1 << size) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


def parts_of(item: Item) -> list[Item]:
    """The item, or if it is long its parts of PART words; the last one ends with the item."""
    n = len(item.words)
    if n <= PART:
        return [item]
    starts = [*range(0, n - PART, PART // 2), n - PART]
    return [Item(item.item_id, item.words[at:at + PART], item.answer) for at in starts]


class Known:
    """Numbers of known words, found by their hashes."""

    def __init__(self, words: list[bytes]):
        hashes = word_hashes([b" ".join(words)], VALUES)[0] if words else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes >> np.uint64(44)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words among the hashes, and their numbers."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), max(0, len(self) - 1))
        hit = self.hashes[place] == hashes[at]
        return at[hit], self.order[place[hit]]


@dataclass
class Cut:
    """Texts cut into blocks: known word and block of each known token, the first block of each text and one more,
    and what is needed to read words back."""

    ids: np.ndarray
    block: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    whole: bytes

    def words(self, text: int, lo: int, hi: int) -> list[bytes]:
        at = self.begin[text]
        return plain_words(self.whole[self.starts[at + lo]:self.ends[at + hi - 1]])


def cut_texts(texts: list[bytes | None], known: Known) -> Cut:
    hashes, n, starts, ends, whole = word_places([t or b"" for t in texts], VALUES, BREAK)
    first = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
    at, ids = known.numbers(hashes) if len(known) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    begin = np.cumsum(n) - n
    text = np.searchsorted(begin, at, side="right") - 1
    return Cut(ids, first[text] + (at - begin[text]) // BLOCK, first, begin, n, starts, ends, whole)


def _summed(parts: Iterator[pa.RecordBatch], dtype: str) -> np.ndarray:
    total = None
    for b in parts:
        for raw in b.column("sums").to_pylist():
            x = np.frombuffer(raw, dtype).astype(np.float64)
            total = x if total is None else total + x
    return total


def _add_up(sums: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Adds the tasks' (part, sums) by part; PARTS rows of a size that the benchmark bounds come back."""
    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_summed(parts, dtype).tobytes()], pa.binary())],
                                         names=["part", "sums"])
    return {r["part"]: np.frombuffer(r["sums"]) for r in sums.groupBy("part").applyInArrow(add, "part int, sums binary").collect()}


def block_counts(docs: DataFrame, words: list[bytes]) -> tuple[np.ndarray, int]:
    """Blocks that hold each known word, and all blocks."""
    known, size = Known(words), len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for b in batches:
            raw = [t or b"" for t in byte_list(b.column(0))]
            for lo, hi in portions(raw):
                cut = cut_texts(raw[lo:hi], known)
                counts[:size] += np.bincount(np.unique(cut.block * size + cut.ids) % size, minlength=size)
                counts[size] += cut.first[-1]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "sums"])

    total = _add_up(docs.select("text").mapInArrow(run, "part int, sums binary"), "<i8").get(0, np.zeros(size + 1))
    return total[:size], int(total[size])


def _passage_sums(rows: np.ndarray, first: np.ndarray, at: np.ndarray | None = None, step: int = 1) -> np.ndarray:
    """For the blocks `at` (all by default), the sum of its row and of the SPAN - 1 after it (step -1: before it) in its text."""
    every = np.arange(len(rows)) if at is None else at
    text = np.searchsorted(first, every, side="right") - 1
    out = rows[every]
    for k in range(1, SPAN):
        other = every + k * step
        ok = other < first[text + 1] if step > 0 else other >= first[text]
        out[ok] += rows[other[ok]]
    return out


def _block_rows(cut: Cut, weight: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per block: weighted sum of the words' rows, sum of squared weights, number of known words."""
    n, ids, block = int(cut.first[-1]), cut.ids, cut.block
    rows, square = np.zeros((n, space.shape[1]), np.float32), np.bincount(block, weight[ids] ** 2, minlength=n).astype(np.float32)
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    weighted = space * weight[:, None]
    rows[block[edge]] = np.add.reduceat(weighted[ids], edge, axis=0)
    return rows, square, np.bincount(block, minlength=n)


def latent_space(docs: DataFrame, items: list[Item], words: list[bytes], weight: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis (known words x rank) of the leading row space of all TF-IDF passages and the items."""
    known, size = Known(words), len(words)
    rank = min(rank, size)
    omega = np.random.default_rng(11).standard_normal((size, rank)).astype(np.float32)
    per = -(-size // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, rank), np.float32)
        for b in batches:
            raw = [t or b"" for t in byte_list(b.column(0))]
            for lo, hi in portions(raw):
                cut = cut_texts(raw[lo:hi], known)
                if not len(cut.ids):
                    continue
                rows, square, _ = _block_rows(cut, weight, omega)
                y = _passage_sums(rows, cut.first) / np.maximum(_passage_sums(square, cut.first), 1e-9)[:, None]
                back = _passage_sums(y, cut.first, step=-1)     # a word counts in every passage that holds its block
                order = np.argsort(cut.ids, kind="stable")
                own = cut.ids[order]
                edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[edge]] += np.add.reduceat(back[cut.block[order]] * weight[own, None], edge, axis=0)
        parts = [total[i * per:(i + 1) * per].tobytes() for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

    parts = _add_up(docs.select("text").mapInArrow(run, "part int, sums binary"), "<f4")
    sums = np.zeros((size, rank))
    for i, x in parts.items():
        sums[i * per:(i + 1) * per] = x.reshape(-1, rank)
    q = item_rows(items, words, weight)
    # The items weigh as much as the corpus, so that one which is rare there is in the space as well.
    own = q.T @ (q @ omega)
    sums = sums / max(np.linalg.norm(sums), 1e-9) + own / max(np.linalg.norm(own), 1e-9)
    return np.linalg.qr(sums)[0].astype(np.float32)


def item_rows(items: list[Item], words: list[bytes], weight: np.ndarray) -> np.ndarray:
    place = {w: n for n, w in enumerate(words)}
    q = np.zeros((len(items), len(words)))
    for i, item in enumerate(items):
        for w in item.words:
            if w in place:
                q[i, place[w]] += weight[place[w]]
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)


def width_of(item: Item) -> int:
    """Words of a stretch that is compared with the item."""
    return math.ceil(1.25 * len(item.words)) + 3


def best_stretch(item: Item, masks: dict[bytes, int], answer: dict[bytes, int], words: list[bytes]) -> tuple[float, float, int, int]:
    """(LCS share, answer share, start, length) of the stretch of the words that is most like the item."""
    size = len(item.words)
    width = min(width_of(item), len(words))
    best = (0.0, 0.0, 0, width)
    for at in range(0, len(words) - width + max(1, size // 4), max(1, size // 4)):
        at = min(at, len(words) - width)
        share = lcs(masks, size, words[at:at + width]) / size
        if share > best[0]:
            best = (share, lcs(answer, len(item.answer), words[at:at + width]) / max(1, len(item.answer)), at, width)
    return best


def is_leak(share: float, answer: float) -> bool:
    return share >= SURE or share >= LIKELY and answer >= ANSWER


@dataclass
class Searcher:
    """What a task needs to find the leaks of a block of items."""

    items: list[Item]
    words: list[bytes]                          # those with a weight
    weight: np.ndarray
    space: np.ndarray

    def __post_init__(self) -> None:
        parts = [(k, part) for k, item in enumerate(self.items) for part in parts_of(item)]
        self.whole = [k for k, _ in parts]      # the item of each part
        q = (item_rows([part for _, part in parts], self.words, self.weight) @ self.space).astype(np.float32)
        # Scaled by what the space keeps of an item, the product with a passage of norm 1 estimates their cosine.
        self.q = q / np.maximum((q ** 2).sum(axis=1, keepdims=True), 1e-6)
        self.known = Known(self.words)
        self.masks = [masks_of(i.words) for i in self.items]
        self.answers = [masks_of(i.answer) for i in self.items]
        own = dict(zip(self.words, self.weight.tolist()))
        self.rare = [{w: own[w] for w in set(part.words) if w in own} for _, part in parts]
        self.least = [RARE * sum(r.values()) for r in self.rare]

    def leaks(self, raw: list[bytes | None]) -> dict[tuple[int, int], tuple]:
        """(number of the text, number of the item) -> cosine, LCS share, answer share, start, length."""
        best: dict[tuple[int, int], tuple] = {}
        wide: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        cut = cut_texts(raw, self.known)
        if not len(cut.ids):
            return best
        rows, square, count = _block_rows(cut, self.weight, self.space)
        at = np.flatnonzero(_passage_sums(count, cut.first) >= 2)
        y = _passage_sums(rows, cut.first, at)
        y /= np.sqrt(_passage_sums(square, cut.first, at))[:, None]
        text_of = np.searchsorted(cut.first, at, side="right") - 1
        for c in range(0, len(at), 4096):
            near = y[c:c + 4096] @ self.q.T
            last = -1
            for p, k in zip(*(x.tolist() for x in np.nonzero(near >= COSINE))):
                if p != last:
                    last, t = p, int(text_of[c + p])
                    begin = int(at[c + p] - cut.first[t]) * BLOCK
                    lo, hi = max(0, begin - BLOCK // 2), min(int(cut.counts[t]), begin + SPAN * BLOCK + BLOCK // 2)
                    stretch = cut.words(t, lo, hi)
                    here = set(stretch)
                rare = self.rare[k]
                if sum([rare[w] for w in here & rare.keys()]) < self.least[k]:
                    continue
                i = self.whole[k]
                if len(self.items[i].words) > PART:
                    reach = width_of(self.items[i])
                    wide.setdefault((t, i), []).append((max(0, lo - reach), min(int(cut.counts[t]), hi + reach), float(near[p, k])))
                    continue
                share, answer, start, n = best_stretch(self.items[i], self.masks[i], self.answers[i], stretch)
                if is_leak(share, answer) and ((t, i) not in best or share > best[t, i][1]):
                    best[t, i] = (float(near[p, k]), share, answer, lo + start, n)
        for (t, i), found in wide.items():
            for lo, hi, cosine in _joined(found):
                share, answer, start, n = best_stretch(self.items[i], self.masks[i], self.answers[i], cut.words(t, lo, hi))
                if is_leak(share, answer) and ((t, i) not in best or share > best[t, i][1]):
                    best[t, i] = (cosine, share, answer, lo + start, n)
        return best


def _joined(stretches: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Stretches with those that overlap made one, which has the largest cosine of them."""
    out: list[tuple[int, int, float]] = []
    for lo, hi, cosine in sorted(stretches):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), max(cosine, out[-1][2]))
        else:
            out.append((lo, hi, cosine))
    return out


def searchers(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Iterator[Searcher]:
    """One for each block of items, fitted to all documents."""
    listed = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    n_words = F.size(F.split("text", r"[\s\p{Punct}]+"))
    n_parts = F.when(n_words > PART, F.ceil((n_words - PART) / (PART // 2)) + 1).otherwise(1)
    blocks = max(1, -(-(listed.agg(F.sum(n_parts)).first()[0] or 0) // ITEMS))
    for k in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [Item(i, w, answer_of(t.encode())) for i, t in part.collect() if (w := plain_words(t.encode()))]    # about ITEMS rows
        items.sort(key=lambda i: (i.item_id is not None, i.item_id or 0, i.words))
        parts = [part for item in items for part in parts_of(item)]
        words = sorted({w for i in items for w in i.words})
        if not words:
            continue
        counts, total = block_counts(docs, words)
        found = dict(zip(words, counts.tolist()))
        kept = {w for w in words if found[w] <= COMMON * total}
        for part in parts:
            kept |= set(sorted(set(part.words), key=lambda w: (found[w], w))[:AT_LEAST])
        words = sorted(kept)
        weight = np.log((total + 1) / (np.array([found[w] for w in words]) + 1)).astype(np.float32) + np.float32(0.01)
        yield Searcher(items, words, weight, latent_space(docs, parts, words, weight, rank))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, word for word or paraphrased."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def runner(searcher: Searcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, raw, out = b.column(0).to_pylist(), byte_list(b.column(1)), []
                for lo in range(0, len(raw), 256):
                    best = searcher.leaks(raw[lo:lo + 256])
                    out += [(ids[lo + t], searcher.items[i].item_id, *v) for (t, i), v in sorted(best.items())]
                cols = list(zip(*out)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])
        return run

    found = [rows.mapInArrow(runner(s), FOUND) for s in searchers(rows, benchmark, rank)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """Rows of `docs`, all columns, that hold no benchmark item; found and dropped in the same stream."""
    at = docs.columns.index("text")

    def runner(searcher: Searcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = byte_list(b.column(at))
                clean = np.ones(len(raw), bool)
                for lo in range(0, len(raw), 256):
                    clean[[lo + t for t, _ in searcher.leaks(raw[lo:lo + 256])]] = False
                yield b.filter(pa.array(clean))
        return run

    for s in list(searchers(docs, benchmark, rank)):
        docs = docs.mapInArrow(runner(s), docs.schema)
    return docs
