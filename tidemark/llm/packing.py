"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document is encoded, ended with one id and cut: whole windows of `capacity` ids stand alone,
the rest is cut into pieces of at most `piece` ids. Pieces are dealt evenly over groups of about
`group_windows` windows. In a group every piece starts as a partition of its own into k windows,
all but one of them empty. The two partitions with the widest spread are merged with opposing
order, the fullest windows of one on the emptiest of the other, until one partition is left, with
windows of nearly equal size. k begins at the least possible count and rises while the fullest
window exceeds the capacity.

Defined results: a null text is empty and gives one piece with the end id alone. Repeated rows
are packed as often as they occur. Ties in spread are merged in the order of arrival. A group is
bounded by its number of documents; texts may be of any length, as long ones add whole windows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import byte_list, pieces_of
from tidemark.llm.tokens import encoder, prove_whole

CAPACITY, PIECE, GROUP_DOCS, END_ID = 2048, 512, 400, 1

Windows = list[tuple[int, list[int]]]


def difference(sizes: list[int], k: int) -> Windows:
    """Split items 0..n-1 of the given sizes into k windows; (-sum, items), fullest first, empty ones left out."""
    heap = [(-s, i, [(-s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    born = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k                     # windows of b that meet a filled window of a
        if over <= 0:
            merged = a + b
        else:
            keep, meet = len(a) - over, len(b) - over
            merged = a[:keep] + b[:meet]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(a[keep:]), b[meet:])]
        merged.sort()
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (merged[0][0] - low, born, merged))
        born += 1
    return heap[0][2] if heap else []


def windows_for(sizes: list[int], capacity: int) -> Windows:
    """The fewest windows, counting up, for which no window exceeds the capacity."""
    k = pieces_of(sum(sizes), capacity)
    while True:
        found = difference(sizes, k)
        excess = -found[0][0] - capacity if found else 0
        if excess <= 0:
            return found
        k += max(1, math.ceil(k * excess / capacity / 4))


def cut(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of whole windows, then of pieces of nearly the same size."""
    found = [(s, capacity) for s in range(0, n - n % capacity, capacity)]
    start = n - n % capacity
    parts = math.ceil((n - start) / piece)
    for i in range(parts):
        length = (n - start) // (parts - i)
        found.append((start, length))
        start += length
    return found


def token_pieces(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, capacity: int = CAPACITY,
                 piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, row (number of the input row), ids."""
    whole = prove_whole(tokenizer_path)
    ending = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer_path, whole), TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), byte_list(b.column(1))):
                ids = enc.ids(text) + ending
                n = len(ids) // 4
                for start, length in cut(n, capacity, piece):
                    own = ids[4 * start:4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(own), n, row, own if with_ids else None))
                row += 1
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, ids binary")


def pack(pieces: DataFrame, n_docs: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Adds sequence_id and offset to pieces (`length`, `row` and any further columns)."""
    groups = pieces_of(n_docs, group_docs)
    names = [c for c in pieces.columns if c != "row"]
    kinds = dict(pieces.dtypes)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sizes = rows.column("length").to_pylist()
        alone = [i for i, s in enumerate(sizes) if s == capacity]
        shared = [i for i, s in enumerate(sizes) if s < capacity]
        windows = [[i] for i in alone]
        windows += [[shared[j] for j in own] for _, own in windows_for([sizes[i] for i in shared], capacity)]
        seq, offset = [0] * len(sizes), [0] * len(sizes)
        for w, own in enumerate(windows):
            at = 0
            for i in own:
                seq[i], offset[i] = (key[0].as_py() << 32) + w, at
                at += sizes[i]
        return (rows.select(names).append_column("sequence_id", pa.array(seq, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    return pieces.withColumn("_group", group).groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, with_ids, capacity), docs.count(), capacity)
