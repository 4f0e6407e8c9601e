"""Hard negatives by an inverted multi-index that is searched until its answer is certain.

Vectors are cut into two halves, each with a codebook; a pair of codes is a cell. Rows are dealt over shards, and
a shard keeps its rows by cell and label. For an anchor, every code has a bound on the half score of the rows behind
it: the score of the code plus the anchor half's length times the code's radius, the largest distance of
a row of the shard from it. A heap goes through the pairs of codes by falling sum of the two bounds (the
multi-sequence walk). The walk stops when no cell left can change the answer: the next sum is under
the last place kept, or under the window's lower end. Cells whose lower bound is over all windows are passed
without being read. So the answer is exact whatever the codebooks are; they only decide how many cells are read.

Two walks per anchor and shard: the best rows of its own label, then, with the scores of its positives
known, the best rows of other labels in each positive's window of scores. Shards hold at most about `SHARD_ROWS` rows and
anchors stream past them, so memory is bounded; what shards found is ranked by anchor with a window of a few rows per shard.

The codebooks are fitted on the driver to at most `SAMPLE` rows, picked by a hash of the row; all rows are indexed and give radii. Scores are integers and computed exactly: in single precision
below 2^24, in double precision below 2^53, with Python's integers beyond.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part. Vectors
shorter than the longest count as ended by zeros. A row repeated exactly counts once; rows that share an id only
are rows of their own, and none of them is a positive or negative for the others. Ties go by smaller id, then label, then digest of the vector. An empty table, or one
without anchors, gives an empty result. A score beyond 64 bits raises an error. Columns other than the three named ones are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import pieces_of
from tidemark.session import checkpointed

SAMPLE, CODES, SHARD_ROWS = 20_000, 32, 65_536
WINDOWS = "array<struct<place:int,score:bigint>>"
ROW = "key long, id long, label int, vec binary"


def valid_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label and the vector as doubles of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine))


def packed_rows(rows: DataFrame, scale: int, width: int, kind: str) -> DataFrame:
    """ROW per row: floor(scale * x) of every component as integers of the numpy type `kind`, with a key of id, label and vector.

    Rows that repeat exactly within a batch come once, so a row repeated millions of times is shuffled as a few.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for i, label, v in zip(*(b.column(k).to_pylist() for k in range(3))):
                x = np.zeros(width)
                x[:len(v)] = v
                raw = np.floor(x * scale).astype(kind).tobytes()
                digest = hashlib.blake2b(raw + f"{i}:{label}".encode(), digest_size=8).digest()
                found[int.from_bytes(digest, "little", signed=True), i, label, raw] = None
            columns = list(zip(*found)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "id", "label", "vec"])
    return rows.select("id", "label", "v").mapInArrow(run, ROW)


def codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres by k-means from evenly spaced points; centres that lose all their points stay where they are."""
    if not points.size:
        return np.zeros((1, points.shape[1]))
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=column, minlength=len(centres)) for column in points.T], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * points @ centres.T, axis=1)


class MultiIndex:
    """Rows of one shard by cell and label."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = books[0].shape[1]
        own = [nearest(part, book) for part, book in zip((vectors[:, :half].astype(float), vectors[:, half:].astype(float)), books)]
        order = np.lexsort((keys, ids, labels, own[1], own[0]))
        self.keys, self.ids, self.labels, whole = keys[order], ids[order], labels[order], vectors[order]
        codes = own[0][order] * len(books[1]) + own[1][order]
        # Radii are of this shard's own rows, in doubles; the slack in `bounds` covers their rounding.
        self.books, self.half = books, half
        self.radii = []
        for part, book, code in ((whole[:, :half], books[0], own[0][order]), (whole[:, half:], books[1], own[1][order])):
            radius = np.full(len(book), -1.0)
            np.maximum.at(radius, code, np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        self.most = float((np.abs(whole).astype(float) ** 2).sum(axis=1).max(initial=0)) ** 0.5
        self.vectors = whole
        self.as_kind: dict[str, np.ndarray] = {}
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(codes)] if len(codes) else starts
        self.cells = {int(codes[s]): (int(s), int(e)) for s, e in zip(starts, ends)}

    def scorer(self, q: np.ndarray):
        """Exact scores of a slice of rows: partial sums stay below the length of one vector times that of the other."""
        size = self.most * float((np.abs(q).astype(float) ** 2).sum()) ** 0.5
        kind = "f4" if size < 2 ** 23 else "f8" if size < 2 ** 52 else "O"
        if kind not in self.as_kind:
            self.as_kind[kind] = self.vectors.astype(kind)
        v, w = self.as_kind[kind], q.astype(kind)
        if kind == "O":
            return lambda s, e: np.array([int(x) for x in v[s:e] @ w], dtype=object)
        return lambda s, e: (v[s:e] @ w).astype(np.int64)

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, start, end) of the filled cells by falling upper bound."""
        sides = []
        for part, book, radius in zip((q[:self.half].astype(float), q[self.half:].astype(float)), self.books, self.radii):
            middle, reach = book @ part, np.sqrt((part ** 2).sum()) * radius
            used = np.flatnonzero(radius >= 0)
            top = middle + reach
            used = used[np.argsort(-top[used], kind="stable")]
            slack = 1e-6 * (1 + np.abs(middle[used]) + reach[used])
            sides.append((used.tolist(), (top[used] + slack).tolist(), (middle[used] - reach[used] - slack).tolist()))
        (a, up_a, low_a), (b, up_b, low_b) = sides
        if not a or not b:
            return
        n_b = len(self.books[1])
        heap = [(-(up_a[0] + up_b[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = self.cells.get(a[i] * n_b + b[j])
            if cell:
                yield -bound, low_a[i] + low_b[j], *cell
            # Every pair is queued once: by the pair to its left, in the first column by the one above.
            if j + 1 < len(b):
                heapq.heappush(heap, (-(up_a[i] + up_b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(up_a[i + 1] + up_b[0]), i + 1, 0))

    def best_of_label(self, anchor: int, label: int, q: np.ndarray, k: int) -> list[tuple]:
        """The k best rows of the anchor's label with another id, as (-score, id, label, key)."""
        scores, kept = self.scorer(q), []
        for bound, _, s, e in self.walk(q):
            if len(kept) == k and bound < -kept[-1][0]:
                break
            lo = s + int(np.searchsorted(self.labels[s:e], label))
            hi = s + int(np.searchsorted(self.labels[s:e], label, side="right"))
            if lo < hi:
                kept = self._merged(kept, scores(lo, hi), lo, self.ids[lo:hi] != anchor, k)
        return kept

    def best_in_windows(self, anchor: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
        """Per window of scores, both ends included: the k best rows of other labels in it with another id."""
        scores, kept = self.scorer(q), [[] for _ in windows]
        open_ = {w for w, (lo, hi) in enumerate(windows) if lo <= hi}
        for bound, low, s, e in self.walk(q):
            open_ = {w for w in open_ if bound >= windows[w][0] and (len(kept[w]) < k or bound >= -kept[w][-1][0])}
            if not open_:
                break
            if low > max(windows[w][1] for w in open_):
                continue
            found = scores(s, e)
            other = (self.labels[s:e] != label) & (self.ids[s:e] != anchor)
            for w in open_:
                inside = (found >= windows[w][0]) & (found <= windows[w][1]) & other
                kept[w] = self._merged(kept[w], found, s, inside, k)
        return kept

    def _merged(self, kept: list[tuple], scores: np.ndarray, at: int, wanted: np.ndarray, k: int) -> list[tuple]:
        if len(kept) == k:
            wanted = wanted & (scores >= -kept[-1][0])
        rows = np.flatnonzero(wanted)
        if not len(rows):
            return kept
        if len(rows) > k:                           # rows from the k-th score on, then by id
            least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
            above, level = rows[scores[rows] > least], rows[scores[rows] == least]
            if len(level) > k:                      # many equal scores: only the k first of them can be kept
                level = level[np.lexsort((self.keys[at + level], self.labels[at + level], self.ids[at + level]))[:k]]
            rows = np.concatenate([above, level])
        more = [(-int(scores[r]), int(self.ids[at + r]), int(self.labels[at + r]), int(self.keys[at + r])) for r in rows.tolist()]
        return sorted(kept + more)[:k]


def _searched(rows: DataFrame, asked: DataFrame, books: tuple[np.ndarray, np.ndarray], kind: str, shard_rows: int, n: int,
              search, schema: str) -> DataFrame:
    """`search(index, anchor row)` of every row of `asked` (ROW and `windows`) in every shard of the n `rows`.

    A task takes a shard and a share of the anchors, about as many as a shard has rows at most: then shards are
    repeated for shares no more often than anchors for shards.
    """
    spark, width = rows.sparkSession, books[0].shape[1] + books[1].shape[1]
    cores, shards, count = spark.sparkContext.defaultParallelism, pieces_of(n, shard_rows), asked.count()
    share = min(shard_rows, max(256, count * shards // (3 * cores)))
    shares = pieces_of(count, share)

    def numbers(most: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    shard, part = F.pmod("key", F.lit(shards)).cast("int"), F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int")
    hubs = rows.select(shard.alias("shard"), numbers(shares).alias("share"), F.lit(0).alias("side"), "key", "id", "label", "vec",
                       F.lit(None).cast(WINDOWS).alias("windows"))
    spokes = asked.select(numbers(shards).alias("shard"), part.alias("share"), F.lit(1).alias("side"), "key", "id", "label", "vec", "windows")
    partitions = min(4 * shards * shares, max(8 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = hubs.unionByName(spokes).repartition(partitions, "shard", "share").sortWithinPartitions("shard", "share", "side")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, index = None, {}, None
        for b in batches:
            out: list[tuple] = []
            for at, share_no, side, *row, windows in zip(*(b.column(c).to_pylist() for c in range(8))):
                if (at, share_no) != current:
                    current, own, index = (at, share_no), {}, None
                if side == 0:
                    own[tuple(row)] = None                  # a row repeated exactly counts once
                    continue
                if index is None:
                    keys, ids, labels, vectors = zip(*own) if own else ((),) * 4
                    index = MultiIndex(*(np.array(c, np.int64) for c in (keys, ids, labels)),
                                       np.frombuffer(b"".join(vectors), kind).reshape(len(own), width), books)
                    own = {}
                out += search(index, *row, windows)
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return dealt.mapInArrow(run, schema)


FOUND = "anchor_key long, anchor_id long, positive_rank int, score long, id long, label int, key long"


def mine(vectors: DataFrame, anchors: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 10, least_percent: int = 30,
         most_percent: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         codes: int = CODES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Hard negatives of every anchor for each of its positives.

    A score is the inner product of the vectors after floor(scale * x). An anchor's positives are its `positives` best other
    rows of the same label; the negatives of a positive are the `negatives` best rows of other labels
    with least_percent * positive_score <= 100 * score <= most_percent * positive_score. `anchors` is a condition on
    `id` (all rows by default), `label` an expression on the columns of `vectors` in place of the label column.
    Returns anchor_id, positive_rank, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = valid_rows(vectors, id_col, vector_col, F.col(label_col) if label is None else label)
    n, width, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)),
                              F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0))).first()
    kind = next((k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 62)) if most * scale + 1 < 2.0 ** bits), None)
    if kind is None:
        raise OverflowError(f"{scale} times a component of {most} is beyond 64 bits")
    # Both searches need the same rows, so they are written once.
    packed = checkpointed(packed_rows(rows, scale, width, kind))
    sample = packed.where(F.pmod("key", F.lit(max(n, 1))) < SAMPLE).orderBy("key").limit(SAMPLE).select("vec").collect()
    points = np.frombuffer(b"".join(r[0] for r in sample), kind).reshape(len(sample), width).astype(float)
    k, half = max(1, min(codes, math.isqrt(len(sample)))), width // 2
    books = (codebook(points[:, :half], k), codebook(points[:, half:], k))
    picked = (packed if anchors is None else packed.where(anchors)).distinct()

    def find_positives(index: MultiIndex, key: int, i: int, own: int, vec: bytes, _windows) -> list[tuple]:
        found = index.best_of_label(i, own, np.frombuffer(vec, kind), positives)
        return [(key, i, 0, -s, j, lab, other) for s, j, lab, other in found]

    def find_negatives(index: MultiIndex, key: int, i: int, own: int, vec: bytes, windows: list[dict]) -> list[tuple]:
        limits = [(-(-least_percent * w["score"] // 100), most_percent * w["score"] // 100) for w in windows]
        found = index.best_in_windows(i, own, np.frombuffer(vec, kind), limits, negatives)
        return [(key, i, w["place"], -s, j, lab, other) for w, kept in zip(windows, found) for s, j, lab, other in kept]

    def ranked(found: DataFrame, name: str, by: list[str], last: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "label", "key")
        return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= last)

    first = _searched(packed, picked.withColumn("windows", F.lit(None).cast(WINDOWS)), books, kind, shard_rows, n, find_positives, FOUND)
    best = checkpointed(ranked(first.drop("positive_rank"), "positive_rank", ["anchor_key", "anchor_id"], positives).select(
        "anchor_key", "anchor_id", "positive_rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = best.groupBy(F.col("anchor_key").alias("key"), F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(
        F.struct(F.col("positive_rank").alias("place"), F.col("positive_score").alias("score")))).alias("windows"))     # `positives` at most
    second = _searched(packed, picked.join(windows, ["key", "id"]), books, kind, shard_rows, n, find_negatives, FOUND)
    found = ranked(second, "rank", ["anchor_key", "anchor_id", "positive_rank"], negatives)
    named = found.join(best, ["anchor_key", "anchor_id", "positive_rank"])
    return named.select("anchor_id", "positive_rank", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
