"""Token counts and token ids with a whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that give one token need no
merging. A text is cut into pre-tokens, and one that was proven whole gives its id at once; only the
rest is merged, by the library's model, and remembered. The shortcut covers printable ASCII and
Latin letters, for which lower-casing and the pre-token pattern are plain; the library encodes
every other chunk between ASCII white space as it is.

Defined results: a null text counts as empty (no bytes, no tokens). A repeated row gives a
repeated result. A text of any length is split without a limit. Other columns are kept out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import byte_list

#: Texts whose lower case, normal form and pre-tokens need no library, if `'` and `<|` don't occur either.
PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿ]*")
PRETOKEN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Merged pre-tokens that a worker keeps; a full table is emptied.
KEPT = 800_000


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one core per task
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole(path: str) -> dict[str, int]:
    """Vocabulary strings that the library encodes alone as one token, with that token's id."""
    tok, alphabet = library(path), _byte_alphabet()
    candidates = set()
    for entry in tok.get_vocab(with_added_tokens=False):
        symbols = entry.removesuffix("</w>")
        if symbols and all(c in alphabet for c in symbols):
            text = bytes(alphabet[c] for c in symbols).decode("utf-8", "replace")
            if PRETOKEN.fullmatch(text) and "'" not in text and "<|" not in text:
                candidates.add(text)
    ordered = sorted(candidates)
    encoded = tok.encode_batch(ordered, add_special_tokens=False)
    return {text: e.ids[0] for text, e in zip(ordered, encoded) if len(e.ids) == 1}


class Encoder(dict):
    """Plain pre-token -> its ids as little-endian unsigned 32-bit bytes; whole tokens from the start."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.tok = library(path)
        self.model = self.tok.model
        self.symbols = {b: c for c, b in _byte_alphabet().items()}
        self.whole = {text: np.uint32(i).tobytes() for text, i in whole.items()}
        self.update(self.whole)

    def __missing__(self, text: str) -> bytes:
        symbols = "".join(map(self.symbols.__getitem__, text.encode()))
        ids = np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
        if len(text) <= 40:                             # a very long one is not worth keeping
            if len(self) >= KEPT:
                self.clear()
                self.update(self.whole)
            self[text] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "'" not in text and "<|" not in text:
            return b"".join(map(self.__getitem__, PRETOKEN.findall(text.lower())))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes | None) -> bytes:
        """Ids of a text. Where it isn't plain, the chunks between white space that aren't go to the library."""
        if not text:
            return b""
        whole = text.decode("utf-8", "replace")
        if PLAIN.fullmatch(whole) and "'" not in whole and "<|" not in whole:
            return b"".join(map(self.__getitem__, PRETOKEN.findall(whole.lower())))
        return b"".join([self._ids(c.decode("utf-8", "replace")) for c in text.split()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, whole: dict[str, int]) -> Encoder:
    """One per Python worker, so that its tables last over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, whole)
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    whole = prove_whole(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, whole)
        for b in batches:
            texts = byte_list(b.column(1))
            n = [len(enc.ids(t)) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
