"""Byte-pair encoding with a priority queue over a linked list of symbols, and its inverse.

A text is cut at special strings and by the byte-level pattern into pre-tokens. A pre-token's bytes
are its first symbols, in a doubly linked list. Every neighbouring pair that the merge table knows
waits in a queue by (rank, place). The least is taken; when its symbols have changed since, the entry
is stale and skipped, else the right symbol joins the left one, is unlinked, and the new pairs on
either side are queued. A worker remembers the ids of short pre-tokens. Decoding joins the bytes of
the vocabulary strings. The `tokenizers` file is read as data; its library only tells, on the driver, to which
class it counts each code point, since its Unicode tables may be of another version than those here.

Defined results: a null text is empty and has no ids; a null list of ids decodes to null, an id that the vocabulary lacks
or a null id is left out. Bytes that are not UTF-8 become U+FFFD. Repeated rows give repeated results. A text of any length is encoded whole; one
pre-token of n bytes takes O(n log n). Of ties in rank the leftmost pair goes first. An empty table gives
an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import byte_list
from tidemark.llm.hashing import portions
from tidemark.llm.tokens import _byte_alphabet

#: Pre-tokens that a worker remembers, up to this many bytes each; a full table is emptied.
KEPT, KEPT_BYTES = 800_000, 48
#: The endings that the byte-level pattern splits off.
ENDINGS = "'(?:[stmd]|re|ve|ll)"
BMP = 0xFFFF
_BEYOND = re.compile("[\U00010000-\U0010ffff]").search


@lru_cache(maxsize=4)
def character_classes(path: str) -> dict[str, list[tuple[int, int]]]:
    """Ranges of letters ("a"), numbers ("1"), white space ("") and the rest ("-") as the file's own pre-tokenizer takes them.

    All code points but the blank and `'`, which the pattern treats apart, are shown to the library in order. Each
    pre-token is then a run of one class, told by whether its first character stays with a letter, a number or a sign.
    """
    from tokenizers import Tokenizer
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in (32, 39)]
    classes: dict[str, list[tuple[int, int]]] = {"a": [], "1": [], "-": [], "": [(32, 32)]}
    for at in range(0, len(points), 4096):
        part = points[at:at + 4096]
        for _, (lo, hi) in cut("".join(map(chr, part))):
            first = chr(part[lo])
            kind = next((k for k in "a1-" if len(cut(k + first)) == 1), "")
            for run in np.split(np.array(part[lo:hi]), np.flatnonzero(np.diff(part[lo:hi]) > 1) + 1):
                classes[kind].append((int(run[0]), int(run[-1])))
    return classes


def pretoken_pattern(classes: dict[str, list[tuple[int, int]]], last: int = 0x10FFFF) -> str:
    """The byte-level pattern with its classes written out up to the code point `last`; letters, the most frequent, come first."""
    letters, numbers, spaces = ("".join(f"\\U{lo:08x}-\\U{min(hi, last):08x}" for lo, hi in classes[k] if lo <= last) for k in ("a", "1", ""))
    return (f" ?[{letters}]+| ?[{numbers}]+|{ENDINGS}| ?[^{spaces}{letters}{numbers}]+"
            f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Codec(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes, filled as they come."""

    def __init__(self, path: str, classes: dict[str, list[tuple[int, int]]]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"] == "BPE" and before["type"] == "ByteLevel" and not before["add_prefix_space"]
                 and spec["normalizer"] is None and not model.get("dropout") and not model.get("ignore_merges"))
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        alphabet, vocab = _byte_alphabet(), model["vocab"]
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for s, i in vocab.items():
            self.strings[i] = bytes(map(alphabet.__getitem__, s))
        for s, i in special.items():
            self.strings[i] = s.encode()
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # Without code points beyond the basic plane the classes are plain tables, far quicker than lists of ranges.
        self.basic, self.whole = (re.compile(pretoken_pattern(classes, last)).findall for last in (BMP, 0x10FFFF))

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        return self.whole(text) if _BEYOND(text) else self.basic(text)

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids after all merges of a pre-token's symbols."""
        merges, n = self.merges, len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                queue.append((found[0], i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = right[i]
            if symbols[i] < 0 or j >= n:
                continue                                    # the left symbol is gone, or it is the last one now
            found = merges.get(symbols[i] << 32 | symbols[j])
            if not found or found[0] != rank:
                continue                                    # one of the two has grown since
            symbols[i], symbols[j] = found[1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                after = merges.get(symbols[i] << 32 | symbols[k])
                if after:
                    heapq.heappush(queue, (after[0], i))
            h = left[i]
            if h >= 0:
                ahead = merges.get(symbols[h] << 32 | symbols[i])
                if ahead:
                    heapq.heappush(queue, (ahead[0], h))
        return [s for s in symbols if s >= 0]

    def __missing__(self, pretoken: str) -> bytes:
        raw = pretoken.encode()
        ids = np.array(self.merge([self.first[b] for b in raw]), "<u4").tobytes()
        if len(raw) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[pretoken] = ids
        return ids

    def _part(self, text: str) -> bytes:
        own = self.special.get(text)
        if own is not None:
            return own
        return b"".join(map(self.__getitem__, self.cut(text)))

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        whole = text.decode("utf-8", "replace")
        if self.split is None or not self.split.search(whole):
            return self._part(whole)
        return b"".join(map(self._part, self.split.split(whole)))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str, classes: dict[str, list[tuple[int, int]]]) -> Codec:
    """One per Python worker, so that what it remembers lasts over tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path, classes)
    return _CODECS[path]


def encode_texts(docs: DataFrame, tokenizer_path: str, decoded: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int) and, if asked for, `decoded`, the text that the ids decode to."""
    classes = character_classes(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path, classes)
        for b in batches:
            texts = byte_list(b.column(1))
            for lo, hi in portions([t or b"" for t in texts], 1 << 22):
                parts = list(map(own.encode, texts[lo:hi]))
                offsets = np.zeros(hi - lo + 1, np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                ids = np.frombuffer(b"".join(parts), "<i4")
                columns = [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array([own.decode(np.frombuffer(p, "<u4").tolist()) for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "ids", *["decoded"] * decoded]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>" + ", decoded string" * decoded)


def decode_ids(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text of its ids."""
    classes = character_classes(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path, classes)
        known = range(len(own.strings))
        for b in batches:
            texts = [None if ids is None else own.decode([i for i in ids if i in known]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    picked = rows.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, f"`{id_col}` long, text string")
