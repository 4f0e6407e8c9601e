"""Removal of repeated word sequences with repeated-phrase automata.

A window is `WINDOW` consecutive words. The words of a window are removed if its word sequence also
starts earlier, in a row with a smaller id or before it in the same row.

1. An anchor is the smallest hash of `GRAM` words in a window; equal windows have equal anchors, and
   about one in eight positions is one. Rows with an equal word sequence are copies of the smallest id.
2. Anchors that occur in two different texts, or twice in one, recur. Every text is cut to its stretches of
   windows with a recurring anchor, and only these windows are counted. Windows that occur twice are joined to
   phrases: neighbours belong together if they occur in the same places, one word apart, so every
   occurrence of any of a phrase's windows lies in an occurrence of the whole phrase.
3. Phrases are dealt over shards by the row of their first occurrence. Every stretch with a recurring window
   goes to the shards that its windows lead to and is streamed through the shard's
   Aho-Corasick automaton; each hit but the first occurrence is removed. The automaton
   compares whole words, so no removal rests on hashes alone.

Hot phrases: counts combine before shuffles, a shard with many texts is split over tasks which each
compile its automaton, and copies never meet each other.

Defined results: a null text has no words. Rows that share an id neither precede each other, so equal
rows get equal results; a null id comes before all others. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import byte_list, compressed, hubs_and_spokes, opened, pieces_of
from tidemark.llm.fingerprint import FIRST, mix
from tidemark.llm.hashing import PLACES, portions, word_hashes
from tidemark.session import checkpointed

WINDOW, GRAM, SHARD_BYTES = 20, 6, 400_000
HEADS = "doc long, text_id long, n_words long, sha binary"
STRETCHES = "doc long, t short, start int, text binary"


def _grams(words: np.ndarray) -> np.ndarray:
    sums = np.zeros(max(0, len(words) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        sums += words[k:k + len(sums)] * PLACES[k]
    return mix(sums)


def _window_least(grams: np.ndarray) -> np.ndarray:
    """The smallest gram of every window of the stream (also of those that cross texts)."""
    width = WINDOW - GRAM + 1
    least, size = grams, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:len(least) - (width - size)], least[width - size:]) if width > size else least


def _window_hash(grams: np.ndarray) -> np.ndarray:
    """Hash of all words of every window of the stream, from grams that cover it."""
    n = max(0, len(grams) - (WINDOW - GRAM))
    sums = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, WINDOW - GRAM, GRAM), WINDOW - GRAM]):
        sums += grams[at:at + n] * PLACES[10 + k]
    return mix(sums)


def _text_id(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _short(text_id: int) -> int:
    """Tells texts apart whose rows share an id."""
    return (text_id & 0xFFFF) - 0x8000


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def read_heads(rows: DataFrame) -> DataFrame:
    """Per row: id, text_id (from the digest), number and digest of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.split() for t in byte_list(b.column(1))]
            sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield _batch(list(zip(b.column(0).to_pylist(), map(_text_id, sha), map(len, words), sha)), HEADS)
    return rows.select("doc", "text").mapInArrow(run, HEADS)


def read_anchors(rows: DataFrame) -> DataFrame:
    """text_id and every distinct anchor of its text; one that occurs twice in the text comes again under ~text_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_list(b.column(0))
            for lo, hi in portions(texts):
                words, counts = word_hashes(texts[lo:hi])
                if len(words) < WINDOW:
                    continue
                stop = np.cumsum(counts)
                grams = _grams(words)
                least, ids, anchors = _window_least(grams), [], []
                for t, i, j in zip(texts[lo:hi], (stop - counts).tolist(), stop.tolist()):
                    if j - i < WINDOW:
                        continue
                    tid = _text_id(hashlib.sha256(b" ".join(t.split())).digest())
                    own = np.unique(least[i:j - WINDOW + 1])
                    every = np.sort(grams[i:j - GRAM + 1])
                    doubled = every[1:][every[1:] == every[:-1]]
                    twice = np.intersect1d(own, doubled) if len(doubled) else own[:0]
                    anchors += [own, twice]
                    ids += [np.full(len(own), tid), np.full(len(twice), ~tid)]
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(anchors).view(np.int64))],
                                                     names=["text_id", "anchor"])
    return rows.select("text").mapInArrow(run, "text_id long, anchor long")


def cut_stretches(rows: DataFrame) -> DataFrame:
    """(doc, compressed text, text_id, anchors) -> runs of windows that hold one of the anchors: doc, t, start (word), text (words).

    Rows whose text isn't the one of text_id are left out: rows that share an id are told apart here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, raw, ids, wanted = b.column(0).to_pylist(), opened(b.column(1)), b.column(2).to_pylist(), b.column(3)
            for lo, hi in portions(raw):
                hashes, counts = word_hashes(raw[lo:hi])
                if len(hashes) < WINDOW:
                    continue
                least, out = _window_least(_grams(hashes)), []
                stop = np.cumsum(counts)
                for k, i, j in zip(range(lo, hi), (stop - counts).tolist(), stop.tolist()):
                    words = raw[k].split()
                    if j - i < WINDOW or _text_id(hashlib.sha256(b" ".join(words)).digest()) != ids[k]:
                        continue
                    rec = wanted[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    held = np.concatenate([[False], np.isin(least[i:j - WINDOW + 1], rec), [False]])
                    edge = np.flatnonzero(held[1:] != held[:-1]).tolist()
                    out += [(docs[k], _short(ids[k]), x, b" ".join(words[x:y + WINDOW - 1])) for x, y in zip(edge[::2], edge[1::2])]
                yield _batch(out, STRETCHES)
    return rows.select("doc", "text", "text_id", "anchors").mapInArrow(run, STRETCHES)


def windows_of(stretches: DataFrame) -> DataFrame:
    """Every window of the stretches: h (hash), doc, t, start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_list(b.column(3))
            for lo, hi in portions(texts):
                words, counts = word_hashes(texts[lo:hi])
                hashes = _window_hash(_grams(words))
                made = counts - WINDOW + 1                      # a stretch has a window at least
                first, at = np.cumsum(counts) - counts, np.cumsum(made) - made
                inside = np.arange(int(made.sum())) - np.repeat(at, made)
                own = [np.repeat(b.column(c).to_numpy()[lo:hi], made) for c in (0, 1, 2)]
                h = hashes[np.repeat(first, made) + inside]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own[0]), pa.array(own[1]), pa.array((own[2] + inside).astype(np.int32))],
                                                 names=["h", "doc", "t", "start"])
    return stretches.mapInArrow(run, "h long, doc long, t short, start int")


def phrases_of(windows: DataFrame) -> DataFrame:
    """Recurring windows joined to phrases: h (of its first window), doc, t and start of its first occurrence, n (words).

    A window and its successor belong together if their occurrences are the same but for a step of one
    word: their numbers agree, and so do the sums (exclusive or) of hashes of all their places.
    """
    counted = (windows.groupBy("h").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "start", "t")).alias("first"),
        F.bit_xor(F.xxhash64("doc", "t", "start")).alias("here"),
        F.bit_xor(F.xxhash64("doc", "t", F.col("start") - 1)).alias("left")).where("c > 1"))
    flat = counted.select("h", "first.doc", "first.t", "first.start", "c", "here", "left")
    along = W.partitionBy("doc", "t").orderBy("start")          # a row's windows: bounded by its length
    follows = ((F.lag("start").over(along) == F.col("start") - 1) & (F.lag("c").over(along) == F.col("c"))
               & (F.lag("here").over(along) == F.col("left")))
    numbered = flat.withColumn("_begins", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("_no", F.sum("_begins").over(along))
    return (numbered.groupBy("doc", "t", "_no").agg(F.min(F.struct("start", "h")).alias("f"), F.max("start").alias("last"))
            .select(F.col("f.h").alias("h"), "doc", "t", F.col("f.start").alias("start"), (F.col("last") + WINDOW - F.col("f.start")).cast("int").alias("n")))


def with_phrase_text(phrases: DataFrame, stretches: DataFrame, shards: int) -> DataFrame:
    """hub (shard), doc, t, start, text (the phrase's words)."""
    grouped = phrases.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("at"))    # bounded by the row's length
    schema = STRETCHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, t, start, text, at in zip(*(c.to_pylist() for c in b.columns)):
                words = text.split()
                out += [(doc, t, a["start"], b" ".join(words[a["start"] - start:a["start"] - start + a["n"]]))
                        for a in at if start <= a["start"] and a["start"] + a["n"] <= start + len(words)]
            yield _batch(out, schema)
    rows = grouped.join(stretches, ["doc", "t"]).select("doc", "t", "start", "text", "at").mapInArrow(run, schema)
    return rows.select(_shard("doc", shards).alias("hub"), "doc", "t", "start", "text")


def _shard(doc: str, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(doc), F.lit(shards))


def locate(phrases: DataFrame, stretches: DataFrame, routes: DataFrame) -> DataFrame:
    """Occurrences of the shards' phrases but for the first: doc, t, start, n (words)."""
    spokes = routes.join(stretches, ["doc", "t"]).select("hub", "doc", "t", "start", "text")
    rows = hubs_and_spokes(phrases, spokes)
    schema = "doc long, t short, start int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        open_ = automaton = None
        ready = False
        for b in batches:
            found: list[tuple] = []
            for hub, salt, side, doc, t, start, text in zip(*(c.to_pylist() for c in b.columns)):
                if (hub, salt) != open_:
                    if side:
                        raise RuntimeError("a text came without its shard's phrases")
                    open_, automaton, ready = (hub, salt), ahocorasick.Automaton(), False
                line = f" {text.decode('latin-1')} "            # a character per byte, a space around each word
                if not side:
                    automaton.add_word(line, (len(line), doc, start, text.count(b" ") + 1))
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                spaces = None
                for end, (size, first, place, n) in automaton.iter(line):
                    if spaces is None:
                        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                    at = start + int(np.searchsorted(spaces, end - size + 1))
                    if (doc, at) != (first, place):
                        found.append((doc, t, at, n))
            yield _batch(found, schema)
    return rows.select("hub", "salt", "side", "doc", "t", "start", "text").mapInArrow(run, schema)


def without(rows: DataFrame, spans: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row with spans: doc, text_id, n_removed, kept (words joined by one space), its sha256."""
    grouped = spans.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("at"))      # bounded by the row's length
    schema = "doc long, text_id long, n_removed long, kept binary, kept_sha string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, t, at in zip(b.column(0).to_pylist(), opened(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = text.split()
                tid = _text_id(hashlib.sha256(b" ".join(words)).digest())
                if _short(tid) != t:
                    continue
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, [a["start"] for a in at], 1)
                np.subtract.at(cover, [a["start"] + a["n"] for a in at], 1)
                gone = (np.cumsum(cover)[:-1] > 0).tolist()
                kept = b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((doc, tid, sum(gone), kept if with_text else None, hashlib.sha256(kept).hexdigest()))
            yield _batch(out, schema)
    return rows.join(grouped, "doc").select("doc", "text", "t", "at").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row doc_id, n_words, n_removed, kept_sha256, and `kept` if `with_text` (null: as it was)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    rows = docs.select(doc.alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    heads = checkpointed(read_heads(rows))
    whole = heads.join(heads.groupBy("sha").agg(F.min("doc").alias("first")), "sha")

    spread = read_anchors(rows)
    recurring = spread.groupBy("anchor").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo < hi").select("anchor")
    marked = spread.join(recurring, "anchor").groupBy("text_id").agg(F.collect_set("anchor").alias("anchors"))   # bounded by the row's length
    # Only the first row of each word sequence goes on.
    single = whole.where("doc = first").select("doc", "text_id").distinct()
    dense = compressed(rows, "doc")                                    # what the two joins with texts shuffle
    stretches = checkpointed(cut_stretches(dense.join(single.join(marked, "text_id"), "doc")))

    size = stretches.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = pieces_of(size, SHARD_BYTES)
    windows = windows_of(stretches)
    phrases = checkpointed(phrases_of(windows.repartition("h")))
    routes = (windows.select("h", "doc", "t").join(phrases.select("h", _shard("doc", shards).alias("hub")), "h")
              .select("doc", "t", "hub").distinct())
    spans = locate(with_phrase_text(phrases, stretches, shards), stretches, routes)
    kept = without(dense, spans.distinct(), with_text).distinct()

    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= WINDOW)
    named = whole.join(kept, ["doc", "text_id"], "left")
    return named.select(
        F.when(F.col("doc") != FIRST, F.col("doc")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
