"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed in levels. On each level runs of one symbol become one symbol; then
deterministic coin tossing gives every symbol a small label from the lowest bit in which it
differs from its left neighbour, three times over, so that labels of neighbours still differ but
take few values. A local maximum of the labels begins a new phrase; a phrase's name is a hash of
its symbols in order, and the names are the symbols of the next level. Cuts depend on a few
neighbours only, so equal substrings get equal names inside, wherever they stand.

A fingerprint holds, for each of the levels 1 to 4, the number of distinct names and the smallest
of their hashes. The likeness of two fingerprints is the estimated share of common names (Dice) on the
highest level where both have enough phrases.

Defined results: a null text is empty; two empty texts have likeness 1, an empty and another 0.
Rows with the same id follow each other by text; a null id comes first. The successor of the last
row is the first, so a single row is its own successor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEVELS = 4
KEPT = (8, 16, 24, 24)                          # smallest hashes kept on each level
ENOUGH = 10                                     # phrases that make a level worth comparing
BATCH_BYTES = 400_000
ROWS_PER_BUCKET = 2_000
FIRST = -(2 ** 63)                              # stands for a null id


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _toss(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which a symbol differs from its left neighbour) + that bit of the symbol."""
    left = np.empty_like(s)
    left[1:] = s[:-1]
    left[starts] = ~s[starts]                   # at a text's start the lowest bit counts as different
    differ = s ^ left
    low = differ & (~differ + np.ones(1, s.dtype))
    at = np.bitwise_count(low - np.ones(1, s.dtype)).astype(np.uint8)
    return 2 * at + ((s & low) != 0).astype(np.uint8)


def _phrases(s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the symbols, and where each text's phrases start."""
    fresh = np.empty(len(s), bool)
    fresh[0] = True
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    fresh[starts] = True
    at = np.flatnonzero(fresh)
    if len(at) < len(s):
        runs = np.diff(at, append=len(s))
        starts = np.searchsorted(at, starts)
        s = s[at]
        long = runs > 1
        s[long] = mix(s[long] + runs[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    label = _toss(_toss(_toss(s, starts), starts), starts)
    begin = np.zeros(len(s), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[starts] = True
    after = starts[1:]                          # a maximum next to the border of two texts isn't one
    begin[after - 1] &= np.isin(after - 1, starts)
    edge = np.flatnonzero(begin)
    place = np.arange(len(s)) - np.repeat(edge, np.diff(edge, append=len(s)))
    terms = mix(s + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    return mix(np.add.reduceat(terms, edge)), np.searchsorted(edge, starts)


def fingerprints(texts: list[bytes]) -> list[str]:
    """One string per text; the texts are parsed together, each on its own."""
    found = [[] for _ in texts]
    filled = [i for i, t in enumerate(texts) if t]
    for i, t in enumerate(texts):
        if not t:
            found[i] = ["0:"] * LEVELS
    if not filled:
        return ["|".join(f) for f in found]
    lengths = np.array([len(texts[i]) for i in filled])
    starts = np.cumsum(lengths) - lengths
    s = np.frombuffer(b"".join(texts[i] for i in filled), np.uint8).astype(np.uint64)
    for level in range(LEVELS):
        s, starts = _phrases(s, starts)
        ends = np.append(starts[1:], len(s))
        short = (mix(s + np.uint64(level)) >> np.uint64(32)).astype(np.uint32)
        for i, lo, hi in zip(filled, starts.tolist(), ends.tolist()):
            names = np.unique(short[lo:hi])
            found[i].append(f"{len(names)}:{names[:KEPT[level]].astype('>u4').tobytes().hex()}")
    return ["|".join(f) for f in found]


def _level(part: str) -> tuple[int, np.ndarray]:
    n, _, names = part.partition(":")
    return int(n), np.frombuffer(bytes.fromhex(names), ">u4")


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone."""
    if a == b:
        return 1.0
    pairs = [(_level(x), _level(y)) for x, y in zip(a.split("|"), b.split("|"))]
    level = max((k for k, ((n, _), (m, _)) in enumerate(pairs) if min(n, m) >= ENOUGH), default=0)
    (n, x), (m, y) = pairs[level]
    if not n or not m:
        return 0.0
    whole = n <= len(x) and m <= len(y)
    least = np.union1d(x, y)
    if not whole:
        least = least[:min(KEPT[level], len(least))]
    common = np.isin(least, x) & np.isin(least, y)
    j = common.mean()
    return float(2 * j / (1 + j))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row doc_id and fingerprint of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            prints: list[str] = []
            for lo, hi in portions(texts):
                prints += fingerprints(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES, which stay in a core's cache."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def with_successors(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, text in ascending buckets: (bucket, side, key, doc_id, text), sorted inside partitions.

    Side 0 holds the bucket's own rows, side 1 the first row of the next bucket that has rows. Only
    cut points and the first id of each bucket pass through the driver, a row per bucket.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    n = max(1, -(-total // rows_per_bucket))
    cuts = np.zeros(0, np.int64)
    if n > 1:
        points = [i / n for i in range(1, n)]
        found = rows.agg(F.percentile_approx("key", points, max(10_000, 4 * n))).first()[0]
        cuts = np.unique(np.array(found, np.int64))

    @F.pandas_udf("long")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right"))

    firsts = {r[0]: r[1] for r in rows.select("key", bucket("key").alias("b")).groupBy("b").agg(F.min("key")).collect()}
    order = sorted(firsts)
    looks = {firsts[b]: order[i - 1] for i, b in enumerate(order)}        # the first bucket's goes to the last

    @F.pandas_udf("array<long>")
    def places(k: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, k.to_numpy(), side="right") * 2
        return pd.Series([[b] if key not in looks else [b, 2 * looks[key] + 1] for b, key in zip(own.tolist(), k)])

    dealt = rows.withColumn("_at", F.explode(places("key")))
    return (dealt.select(F.floor(F.col("_at") / 2).alias("bucket"), (F.col("_at") % 2).alias("side"), "key", "doc_id", "text")
            .repartition("bucket").sortWithinPartitions("bucket", "side", "key", "text"))


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter (floor) of its code points
    replaced by as many first ones, or all, of the next document's."""
    def rows_of(own: list[tuple[int | None, str]], after: str) -> list[tuple]:
        """`own` rows in order and the text that follows the last."""
        texts = [t for _, t in own]
        edited = []
        for t, n in zip(texts, [*texts[1:], after]):
            q = len(t) // 4
            edited.append((t[:len(t) - q] + n[:q]).encode())
        raw = [t.encode() for t in [*texts, after]]
        prints, changed = [], []
        for lo, hi in portions(raw):
            prints += fingerprints(raw[lo:hi])
        for lo, hi in portions(edited):
            changed += fingerprints(edited[lo:hi])
        return [(d, len(t), hashlib.sha256(e).hexdigest(), p, c, likeness(p, c), likeness(p, q))
                for (d, t), e, p, c, q in zip(own, edited, prints, changed, prints[1:])]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in EDITED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, waiting = None, []
        for b in batches:
            done: list[tuple] = []
            for bucket, side, doc, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if side == 1:
                    if waiting:                             # a repeated first row comes more than once
                        done += rows_of(waiting, text)
                        waiting = []
                    continue
                if bucket != open_bucket and waiting:
                    raise RuntimeError("a bucket has no following row")
                open_bucket = bucket
                waiting.append((doc, text))
                if len(waiting) > 200:
                    done += rows_of(waiting[:-1], waiting[-1][1])
                    waiting = waiting[-1:]
            yield batch_of(done)
        if waiting:
            raise RuntimeError("a bucket has no following row")

    return with_successors(docs).mapInArrow(run, EDITED)
