"""Quality scores: logistic regression on hashed word n-grams, trained with FTRL updates.

Every chunk between ASCII white space gives a word (lower case, outer punctuation off) and a shape
(runs of capitals, small letters and digits as A, a, 0; other characters as they are). A word of more than
WORD bytes or a shape of more than SHAPE signs is read on in pieces of that size, none of which is left out. Features
are words, word pairs, shapes and shape pairs, hashed to `2 ** BITS` weights; a pair of equal words
is one feature of its own, which marks repetition. A document's vector is its feature counts
divided by its number of words or of shapes, so a score is one sparse dot product.

Training takes at most `max_rows` labelled documents, chosen by a hash of their id (documented
bound), in up to SHARDS tasks. Each runs follow-the-regularised-leader (proximal) updates on
small batches over several passes; the weights are averaged. Everything is scored.

Defined results: a null or empty text has no features and gets the score of the bias. Rows with
the same id are each scored. Without labels every score is 0.5. Null labels are left out; a doc_id
labelled more than once takes its lowest label. Columns other than id and text are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import byte_list

BITS, SHARDS, MAX_ROWS = 18, 4, 10_000
PASSES, BATCH = 4, 16
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
SCALE = 4.0                                     # of the share of a feature in a document
SMALL, CAPITAL, DIGITS = re.compile("[a-zß-öø-ÿ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+")
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KEPT, WORD, SHAPE, MORE = 400_000, 200, 8, 0


def _cut(word: bytes) -> list[bytes]:
    """Successive pieces of at most WORD bytes that end between code points; together they are the word."""
    out, at = [], 0
    while len(word) - at > WORD:
        stop = at + WORD
        while word[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(word[at:stop])
        at = stop
    return [*out, word[at:]]


def pieces(chunk: bytes) -> tuple[list[int], list[int]]:
    """Hashes of all pieces of the chunk's word and of its shape."""
    text = chunk.decode("utf-8", "replace")
    word = text.lower().strip(OUTER).encode()
    shape = DIGITS.sub("0", CAPITAL.sub("A", SMALL.sub("a", text)))
    return [zlib.crc32(p) for p in _cut(word)], [zlib.crc32(shape[i:i + SHAPE].encode()) for i in range(0, len(shape), SHAPE)]


class Chunks(dict):
    """Chunk -> hash of its word in the high half, hash of its shape in the low half; MORE if either has several pieces."""

    def __missing__(self, chunk: bytes) -> int:
        if len(chunk) > WORD:
            return MORE                         # long ones aren't kept
        words, shapes = pieces(chunk)
        value = words[0] << 32 | shapes[0] if len(words) == len(shapes) == 1 else MORE
        if len(self) >= KEPT:
            self.clear()
        self[chunk] = value
        return value


_CHUNKS = Chunks()


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    """Feature numbers of hashes: multiplication keeps the high bits."""
    return ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _with_pieces(first: np.ndarray, more: np.ndarray, found: list[list[int]], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their texts, all pieces in place of each chunk that has several."""
    made = np.ones(len(first), np.int64)
    made[more] = [len(f) for f in found]
    out = np.repeat(first, made)
    out[np.repeat(more, made)] = [h for f in found for h in f]
    return out, np.repeat(doc, made)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts, the text of each, and what each counts: 1 by the text's number of words or shapes."""
    chunks = [t.split() if t else [] for t in texts]
    n = np.fromiter(map(len, chunks), np.int64, len(chunks))
    both = np.fromiter((_CHUNKS[c] for own in chunks for c in own), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    word, shape, more = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF), both == MORE
    word_doc = shape_doc = doc
    if more.any():
        begin = np.cumsum(n) - n
        found = [pieces(chunks[t][i]) for t, i in zip(doc[more].tolist(), (np.flatnonzero(more) - begin[doc[more]]).tolist())]
        word, word_doc = _with_pieces(word, more, [w for w, _ in found], doc)
        shape, shape_doc = _with_pieces(shape, more, [s for _, s in found], doc)
    k = np.uint64(0x100000001B3)
    before_w, before_s = np.roll(word, 1), np.roll(shape, 1)
    for before, own in ((before_w, word_doc), (before_s, shape_doc)):
        before[np.diff(own, prepend=-1) > 0] = 7            # the first one follows a fixed mark
    pair = before_w * k + word
    pair[before_w == word] = 11
    out = np.concatenate([_spread(word, 1), _spread(shape, 2), _spread(pair, 3), _spread(before_s * k + shape, 4)]).astype(np.int32)
    shares = [(1 / np.maximum(np.bincount(own, minlength=len(n)), 1))[own] for own in (word_doc, shape_doc)]
    return out, np.concatenate([word_doc, shape_doc] * 2), np.concatenate(shares * 2)


def _scores(out: np.ndarray, doc: np.ndarray, share: np.ndarray, size: int, w: np.ndarray, bias: float) -> np.ndarray:
    sums = np.bincount(doc, w[out] * share, minlength=size) * SCALE
    return 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))


def ftrl(texts: list[bytes | None], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias after PASSES over the documents in batches of BATCH."""
    size = 1 << BITS
    z, sq, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    sets = [features(texts[i:i + BATCH]) for i in range(0, len(texts), BATCH)]
    ys = [labels[i:i + BATCH] for i in range(0, len(texts), BATCH)]
    order = np.random.default_rng(5)
    for _ in range(PASSES):
        for i in order.permutation(len(sets)):
            (out, doc, share), y = sets[i], ys[i]
            miss = _scores(out, doc, share, len(y), w, w[size]) - y
            g = np.bincount(out, miss[doc] * SCALE * share, minlength=size + 1)
            g[size] = miss.sum()
            at = np.flatnonzero(g)
            g = g[at]
            new = sq[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(sq[at])) / ALPHA * w[at]
            sq[at] = new
            free = np.where(at == size, 0.0, L1)                # the bias isn't shrunk
            w[at] = np.where(np.abs(z[at]) <= free, 0.0,
                             -(z[at] - np.sign(z[at]) * free) / ((BETA + np.sqrt(new)) / ALPHA + L2))
    return w[:size].astype(np.float32), float(w[size])


def train(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """`labels` (doc_id and the label, already without held-out rows) joined to texts; averaged shard models."""
    one = (labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.min(label_col).cast("int").alias("_y")))
    total = one.count()
    if total == 0:
        return np.zeros(1 << BITS, np.float32), 0.0
    share = int(1e6 * min(1.0, max_rows / total))
    shards = max(1, min(SHARDS, -(-min(total, max_rows) // (max_rows // SHARDS))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # At most about max_rows rows of 12 bytes, so the broadcast is bounded.
    chosen = F.broadcast(one.where(draw < share))
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
            .withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")))

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by("doc_id")
        y = np.array(part.column("_y").to_pylist(), float)
        w, bias = ftrl(byte_list(part.column("text")), y)
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "bias": [bias]})

    # SHARDS models of 2 ** BITS numbers come back, whatever the size of the data.
    models = rows.groupBy("_shard").applyInArrow(fit, "w binary, bias double").collect()
    if not models:
        return np.zeros(1 << BITS, np.float32), 0.0
    w = np.mean([np.frombuffer(m["w"], np.float32) for m in models], axis=0).astype(np.float32)
    return w, float(np.mean([m["bias"] for m in models]))


def score(docs: DataFrame, model: tuple[np.ndarray, float], to: str = "score") -> DataFrame:
    """All columns of `docs` that the caller kept besides text: doc_id and the score of the whole text."""
    w, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_list(b.column(1))
            found = [_scores(*features(own), len(own), w, bias) for own in (texts[i:i + 256] for i in range(0, len(texts), 256))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else [], pa.float64())],
                                             names=["doc_id", to])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, `{to}` double")


def keep(docs: DataFrame, model: tuple[np.ndarray, float], least: float) -> DataFrame:
    """Rows of `docs`, all columns, whose text scores `least` or more; scored in the stream, without a shuffle."""
    w, bias = model
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_list(b.column(at))
            found = [_scores(*features(own), len(own), w, bias) for own in (texts[i:i + 256] for i in range(0, len(texts), 256))]
            yield b.filter(pa.array(np.concatenate(found) >= least if found else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
