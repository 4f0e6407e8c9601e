"""Language model scores from an Elias-Fano n-gram trie.

Order two with a Dirichlet prior: p(w | u) = (c(u w) + MU p(w)) / (C(u) + MU), and
p(w) = (c(w) + 1) / (N + V + 1) over the training tokens. A text begins after a start mark, which is no token,
and ends with an end token.

The corpus is read in blocks of about `BLOCK_BYTES`. (1) Each block sends its distinct words with their
training counts to vocabulary shards, which return numbers and total counts for that block's words alone, so the
vocabulary is never held whole. (2) Each block sends its word pairs, packed and compressed, to
model shards; a context with many tokens is spread over several. (3) A shard adds up the training
counts of its pairs, lays them out as a trie in a memory-mapped file (contexts, pointers to
their successors and the successors themselves as Elias-Fano sequences, quantised log probabilities beside
them), and looks up every pair of every block: the context, then the successor inside the
context's range; a pair that isn't there backs off. Per block the sums of its texts come back.

Defined results: a null text is empty and has the end token alone. Rows that repeat are read as often as they
occur. Without training rows N and V are 0, and every token is unknown. Other columns are not read.
"""

from __future__ import annotations

import mmap
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import byte_list, pieces_of
from tidemark.llm.fingerprint import mix
from tidemark.llm.hashing import FOLDED, portions, word_hashes
from tidemark.session import checkpointed

MU, SCALE, BLOCK_BYTES = 30.0, 4096.0, 12_000_000
END, START = np.uint64(0xE0D), -1               # hash of the end token; number of the start mark
DOCS_PER_VOCABULARY, DOCS_PER_MODEL = 20_000, 6_000
BLOCKS = "block long, shard int, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in the smallest type that holds them, compressed."""
    small = [a.astype(np.min_scalar_type(int(a.max()))) if len(a) and a.dtype.kind in "iu" and a.min() >= 0 else a for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(small))


def unpacked(data: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


class EliasFano:
    """A monotone sequence as low bits and unary high bits, with a count of ones per word for searches."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        w = np.uint64(width)
        high_at = (values >> w) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(((top >> width) + n + 64) // 64 * 64 + 64, np.uint8)
        bits[high_at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            at = np.arange(n, dtype=np.uint64) * w
            part, word, shift = values & ((np.uint64(1) << w) - np.uint64(1)), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + w > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, width, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    @staticmethod
    def _nth_bit(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the one with `rank` ones before it in each word, by halving."""
        place, rest, rank = np.zeros(len(words), np.uint64), words.copy(), rank.copy()
        for step in (32, 16, 8, 4, 2, 1):
            s = np.uint64(step)
            below = np.bitwise_count(rest & ((np.uint64(1) << s) - np.uint64(1))).astype(np.int64)
            right = rank >= below
            rank -= np.where(right, below, 0)
            place += np.where(right, s, np.uint64(0))
            rest = np.where(right, rest >> s, rest)
        return place.astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number k, the end of the bucket k of high parts."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.minimum(np.searchsorted(zeros, k, side="right") - 1, len(self.high) - 1)
        return word * 64 + self._nth_bit(~self.high[word], k - zeros[word])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        w = np.uint64(self.width)
        at = i.astype(np.uint64) * w
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.low[word] >> shift
        over = shift + w > 64
        part[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return part & ((np.uint64(1) << w) - np.uint64(1))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + self._nth_bit(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def find_within(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of each x among the places lo to hi - 1, by halving; -1 if it isn't there."""
        lo, hi = lo.copy(), hi.copy()
        end = hi.copy()
        while True:
            wide = np.flatnonzero(lo < hi)
            if not len(wide):
                break
            mid = (lo[wide] + hi[wide]) // 2
            less = self.get(mid) < x[wide]
            lo[wide] = np.where(less, mid + 1, lo[wide])
            hi[wide] = np.where(less, hi[wide], mid)
        out = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero(lo < end)
        ok = ok[self.get(lo[ok]) == x[ok]]
        out[ok] = lo[ok]
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x in the sequence, by a search in the bucket of its high part; -1 if it isn't there."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = (x >> np.uint64(self.width)).astype(np.int64)
        last = int(self.get(np.array([self.n - 1]))[0] >> np.uint64(self.width))
        ok = np.flatnonzero(h <= last)
        h, want = h[ok], x[ok] & ((np.uint64(1) << np.uint64(self.width)) - np.uint64(1))
        hi = self._zero(h) - h
        lo = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        while True:                                             # halve all buckets that are still open
            wide = np.flatnonzero(lo < hi)
            if not len(wide):
                break
            mid = (lo[wide] + hi[wide]) // 2
            got = self.lows(mid)
            hit = got == want[wide]
            out[ok[wide[hit]]] = mid[hit]
            lo[wide] = np.where(got < want[wide], mid + 1, lo[wide])
            hi[wide] = np.where(hit, lo[wide], np.where(got < want[wide], hi[wide], mid))
        return out


class Trie:
    """Contexts, the start of each one's successors, successors made monotone by the context's place, and values."""

    def __init__(self, ctx: np.ndarray, nxt: np.ndarray, values: np.ndarray):
        """Pairs sorted by context, then successor; values are quantised -log10 probabilities."""
        edge = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
        self.span = np.uint64(int(nxt.max()) + 1 if len(nxt) else 1)
        order = np.repeat(np.arange(len(edge)), np.diff(edge, append=len(ctx)))
        levels = [EliasFano.of(ctx[edge].astype(np.uint64)), EliasFano.of(np.append(edge, len(ctx))),
                  EliasFano.of(order.astype(np.uint64) * self.span + nxt.astype(np.uint64))]
        codes = np.minimum(np.round(values * SCALE), 65535).astype(np.uint16)
        flat = [a for level in levels for a in level.arrays()] + [codes]
        # The levels live in one file that is mapped and has no name, so it goes with the task.
        with tempfile.TemporaryFile() as f:
            for a in flat:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
            f.flush()
            self.bytes = sum(a.nbytes + -a.nbytes % 8 for a in flat)
            self.map = mmap.mmap(f.fileno(), max(self.bytes, 1), access=mmap.ACCESS_READ) if self.bytes else b""
        at, views = 0, []
        for a in flat:
            views.append(np.frombuffer(self.map, a.dtype, len(a), at))
            at += a.nbytes + -a.nbytes % 8
        self.contexts, self.pointers, self.successors = [
            EliasFano(level.n, level.width, *views[3 * k:3 * k + 3]) for k, level in enumerate(levels)]
        self.codes = views[9]

    def look_up(self, ctx: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """log10 p of each pair, nan where it isn't there."""
        out = np.full(len(ctx), np.nan)
        own, back = np.unique(ctx, return_inverse=True)
        place = self.contexts.find(own.astype(np.uint64))[back]
        ok = np.flatnonzero((place >= 0) & (nxt.astype(np.uint64) < self.span))
        # The context's pointer and the next one bound its successors, and only those are searched.
        lo, hi = (self.pointers.get(place[ok] + k).astype(np.int64) for k in (0, 1))
        at = self.successors.find_within(place[ok].astype(np.uint64) * self.span + nxt[ok].astype(np.uint64), lo, hi)
        hit = at >= 0
        out[ok[hit]] = self.codes[at[hit]] / -SCALE
        return out


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(block number, ids, held, hashes of distinct tokens, token places, tokens per text) for every block of the partition."""
    block = TaskContext.get().partitionId() << 32
    for b in batches:
        ids, held, raw = b.column(0).to_pylist(), np.array(b.column(2).to_pylist(), bool), [t or b"" for t in byte_list(b.column(1))]
        for lo, hi in portions(raw, BLOCK_BYTES):
            parts, counts = [], []
            for i, j in portions(raw[lo:hi]):
                words, n = word_hashes(raw[lo + i:lo + j], FOLDED)
                ends = np.cumsum(n)
                parts.append(np.insert(words, ends, END))
                counts.append(n + 1)
            tokens, n = np.concatenate(parts), np.concatenate(counts)
            own, place = np.unique(tokens, return_inverse=True)
            yield block, ids[lo:hi], held[lo:hi], own, place, n
            block += 1


def _check(own: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(own)) & 0x7FFFFFFFFFFFFFFF


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.binary()])], names=["block", "shard", "data"])


def vocabulary(rows: DataFrame, shards: int) -> DataFrame:
    """Per block and shard the numbers and training counts of the block's words, and per shard (block -1) tokens and distinct ones."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, held, own, place, n in _blocks(batches):
            train = np.bincount(place, np.repeat(~held, n), minlength=len(own)).astype(np.int64)
            to = (own % np.uint64(shards)).astype(np.int64)
            yield _table([(block, s, packed(own[to == s], train[to == s])) for s in range(shards)])

    def number(key: tuple, part: pa.Table) -> pa.Table:
        blocks, shard = part.column("block").to_pylist(), key[0].as_py()
        data = [unpacked(d) for d in part.column("data").to_pylist()]
        sizes = np.array([len(h) for h, _ in data])
        known, place = np.unique(np.concatenate([h.astype(np.uint64) for h, _ in data]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, c in data]).astype(float), minlength=len(known)).astype(np.int64)
        stop = np.cumsum(sizes)
        rows = [(b, shard, packed(place[i:j] * shards + shard, total[place[i:j]]))
                for b, i, j in zip(blocks, (stop - sizes).tolist(), stop.tolist())]
        rows.append((-1, shard, packed(np.array([total.sum(), (total > 0).sum()]))))
        return pa.Table.from_batches([_table(rows)])

    return rows.mapInArrow(send, BLOCKS).groupBy("shard").applyInArrow(number, BLOCKS)


def pair_blocks(rows: DataFrame, numbers: DataFrame, shards: int, models: int, n: int, v: int) -> DataFrame:
    """Packets of every block for the model shards (data: contexts, successors, ...), and one with its texts (shard -1)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, held, own, place, tokens in _blocks(batches):
            data = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(
                (ids, held, (own % np.uint64(shards)).astype(np.uint16), place.astype(np.uint32), tokens.astype(np.int32))))
            yield _table([(block, -1, data)])

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_table([])])
        block = left.column("block")[0].as_py()
        ids, held, to, place, tokens = pickle.loads(zstandard.ZstdDecompressor().decompress(left.column("data")[0].as_py()))
        number, count = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
        for s, d in zip(right.column("shard").to_pylist(), right.column("data").to_pylist()):
            own_n, own_c = unpacked(d)
            at = np.flatnonzero(to == s)
            if len(at) != len(own_n):
                raise RuntimeError("a block was cut otherwise when it was read again")
            number[at], count[at] = own_n, own_c
        doc = np.repeat(np.arange(len(tokens)), tokens)
        start = np.cumsum(tokens) - tokens
        c = count[place]
        sums = [np.bincount(doc, x, minlength=len(tokens)) for x in (np.log10(c + 1.0), (c > 0).astype(float))]
        out = [(block, -1, zstandard.ZstdCompressor(level=1).compress(pickle.dumps((ids, held, tokens, *sums))))]

        nxt = number[place]
        ctx, big = np.empty_like(nxt), np.empty_like(c)
        ctx[1:], big[1:] = nxt[:-1], c[:-1]
        ctx[start], big[start] = START, -1                      # every text's first token follows the start mark
        fan = 1 + np.where(big < 0, len(tokens), big) * models * 4 // max(n, 1)
        where = ((mix(ctx.astype(np.uint64)) >> np.uint64(8)) % np.uint64(1 << 40)
                 + (mix(nxt.astype(np.uint64)) >> np.uint64(8)) % fan.astype(np.uint64)) % np.uint64(models)
        ctx += 1                                                # 0 is the start mark
        order = np.lexsort((nxt, ctx, where))
        bounds = np.searchsorted(where[order], np.arange(models + 1).astype(np.uint64))
        trained = ~held[doc]
        for m in range(models):
            own = order[bounds[m]:bounds[m + 1]]
            if not len(own):
                continue
            x, y = ctx[own], nxt[own]
            edge = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            x, y = x[edge], y[edge]
            fresh = np.concatenate([[True], x[1:] != x[:-1]])
            out.append((block, m, packed(x[fresh], np.diff(np.flatnonzero(fresh), append=len(x)), big[own][edge][fresh] + 1, y,
                                         c[own][edge], np.add.reduceat(trained[own].astype(np.int64), edge),
                                         np.diff(edge, append=len(own)), doc[own])))
        return pa.Table.from_batches([_table(out)])

    read = rows.mapInArrow(send, BLOCKS).groupBy("block")
    return read.cogroup(numbers.where("block >= 0").groupBy("block")).applyInArrow(pairs, BLOCKS)


def scored_blocks(packets: DataFrame, models: int, n: int, v: int, starts: int) -> DataFrame:
    """Per block and model shard the sums of log10 p of its texts; the texts' own packets pass through."""
    def score(key: tuple, part: pa.Table) -> pa.Table:
        out, blocks, data = [], [], []
        for b, s, d in zip(*(part.column(c).to_pylist() for c in ("block", "shard", "data"))):
            if s < 0:
                out.append((b, -1, d))
            else:
                blocks.append(b)
                data.append(unpacked(d))
        if blocks:
            ctx = [np.repeat(x, k).astype(np.int64) for x, k, *_ in data]
            nxt = [y.astype(np.int64) for _, _, _, y, *_ in data]
            # A context's count is sent as count + 1; 0 stands for the start mark.
            big = [np.repeat(np.where(g == 0, starts, g.astype(np.int64) - 1), k) for _, k, g, *_ in data]
            own_p = [(c.astype(float) + 1) / (n + v + 1) for *_, c, _, _, _ in data]
            every = np.stack([np.concatenate(ctx), np.concatenate(nxt)])
            train = np.concatenate([t for *_, t, _, _ in data]).astype(np.int64)
            order = np.lexsort((every[1], every[0]))
            x, y = every[0][order], every[1][order]
            edge = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            c = np.add.reduceat(train[order], edge)
            p, g = np.concatenate(own_p)[order][edge], np.concatenate(big)[order][edge]
            held = c > 0
            trie = Trie(x[edge][held], y[edge][held], -np.log10((c + MU * p) / (g + MU))[held])
            for b, u, w, s, q, (*_, times, docs) in zip(blocks, ctx, nxt, big, own_p, data):
                found = trie.look_up(u, w)
                back = np.log10(MU / (s + MU)) + np.log10(q)
                each = np.repeat(np.where(np.isnan(found), back, found), times)
                sums = np.bincount(docs.astype(np.int64), each)
                out.append((b, key[0].as_py(), packed(sums)))
        return pa.Table.from_batches([_table(out)])

    to = F.when(F.col("shard") < 0, F.pmod(F.xxhash64("block"), F.lit(models)).cast("int")).otherwise(F.col("shard"))
    return packets.groupBy(to.alias("_to")).applyInArrow(score, BLOCKS)


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows not held out are learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held"))
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(1 - F.col("held").cast("int")), F.lit(0))).first()
    shards, models = pieces_of(total[0], DOCS_PER_VOCABULARY), pieces_of(total[0], DOCS_PER_MODEL)
    numbers = checkpointed(vocabulary(rows, shards))
    known = [unpacked(r["data"])[0] for r in numbers.where("block < 0").collect()]        # a row of two numbers per shard
    n, v = (int(sum(int(k[i]) for k in known)) for i in (0, 1))
    packets = pair_blocks(rows, numbers, shards, models, n, v)
    sums = scored_blocks(packets, models, n, v, int(total[1]))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def add(key: tuple, part: pa.Table) -> pa.Table:
        score = None
        for s, d in sorted(zip(part.column("shard").to_pylist(), part.column("data").to_pylist()), key=lambda r: r[0]):
            if s < 0:
                ids, held, tokens, logs, seen = pickle.loads(zstandard.ZstdDecompressor().decompress(d))
                score = np.zeros(len(ids))
            else:
                own = unpacked(d)[0]
                score[:len(own)] += own
        base = logs - tokens * np.log10(n + v + 1)
        cols = [ids, held, tokens, seen.astype(np.int64), np.full(len(ids), n), base, score]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return sums.groupBy("block").applyInArrow(add, schema)
