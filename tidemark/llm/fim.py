"""Fill-in-the-middle transformation with a sparse index of the characters that take more than one byte.

A text is cut in three at two places, counted in lines or in code points, and its parts are put in another order between
marks. Texts stay UTF-8 bytes. Per portion of texts only the multibyte characters are recorded, each by its place and the
bytes it takes beyond one. A cut moves between code points and bytes by a binary search among them; between two of them
the difference is a constant, so an ASCII text is pure arithmetic. Cuts, forms and lengths of all texts of a portion
are computed at once in numpy. Where the cuts fall and which form a text gets depends on its id and the seed alone.

Defined results: a null or empty text is plain and empty. A text that holds a mark stays plain, whole, so that every output
can be put back together. Bytes that are not UTF-8 become U+FFFD. A null id is written as an empty string in the hash.
Repeated rows give repeated results, as do equal ids (the same draws over their own texts). A text of any length is cut over its
whole length. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import byte_list
from tidemark.llm.hashing import portions

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_WIDTH = np.ones(256, np.int64)                 # bytes of a character by its first byte
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4


class ExceptionIndex:
    """Places of the multibyte characters of a byte string, by bytes and by code points, and their excess so far."""

    def __init__(self, buf: np.ndarray):
        self.bytes_at = np.flatnonzero(buf >= 0xC0)
        self.excess = np.concatenate([[0], np.cumsum(_WIDTH[buf[self.bytes_at]] - 1)])
        self.chars_at = self.bytes_at - self.excess[:-1]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code points ahead of byte offsets that lie between characters."""
        return at - self.excess[np.searchsorted(self.bytes_at, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes ahead of code point offsets."""
        return at + self.excess[np.searchsorted(self.chars_at, at)]


def draws(seed: int, ids: Sequence[int | None]) -> np.ndarray:
    """Four numbers per id: the first 8-digit groups of the hex sha256 of `seed:id`."""
    raw = b"".join([hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids])
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def cut_places(texts: Sequence[bytes], drawn: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Per text: number of units, byte offsets of the two cuts in it, code points ahead of each."""
    whole = b"".join(texts)
    buf = np.frombuffer(whole, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate([[0], ends[:-1]])
    index = ExceptionIndex(buf)
    chars_before = index.to_chars(starts)
    if unit == "line":
        breaks = np.flatnonzero(buf == 10)
        first = np.searchsorted(breaks, starts)
        closed = np.searchsorted(breaks, ends) - first
        filled = ends > starts
        last = np.zeros(len(texts), bool)
        last[filled] = buf[ends[filled] - 1] != 10
        n = closed + last
    else:
        n = index.to_chars(ends) - chars_before
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    places = []
    for units in (np.minimum(one, two), np.maximum(one, two)):
        if unit == "line":
            after = np.append(breaks, 0)[np.minimum(first + np.maximum(units, 1) - 1, len(breaks))] + 1
            places.append(np.where(units == 0, starts, np.where(units <= closed, after, ends)))
        else:
            places.append(index.to_bytes(chars_before + units))
    return (n, *[p - starts for p in places], *[index.to_chars(p) - chars_before for p in places])


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, percent_spm: int = 50,
                   marks: Sequence[str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (units of the text), form, prefix_chars, middle_chars (null if plain), output.

    unit is "line" (with its line feed) or "char". `percent` of the ids are transformed, of these `percent_spm` with
    the suffix first: form psm is P prefix S suffix M middle, spm is S suffix P prefix M middle, plain the text as it is.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unit {unit!r} is neither 'line' nor 'char'")
    p_mark, s_mark, m_mark = raw_marks = [m.encode() for m in marks]

    def rows_of(ids: list[int | None], texts: list[bytes]) -> tuple[list, ...]:
        whole = b" ".join(texts)
        try:
            whole.decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        marked = any(m in whole for m in raw_marks)
        drawn = draws(seed, ids)
        n, a, b, a_chars, b_chars = (v.tolist() for v in cut_places(texts, drawn, unit))
        chosen = (drawn[:, 2] % 100 < percent).tolist()
        spm = (drawn[:, 3] % 100 < percent_spm).tolist()
        form, prefix, middle, out = [], [], [], []
        for i, t in enumerate(texts):
            if not t or not chosen[i] or marked and any(m in t for m in raw_marks):
                form.append("plain")
                prefix.append(None)
                middle.append(None)
                out.append(t)
                continue
            lo, hi = a[i], b[i]
            parts = (s_mark, t[hi:], p_mark, t[:lo]) if spm[i] else (p_mark, t[:lo], s_mark, t[hi:])
            form.append("spm" if spm[i] else "psm")
            prefix.append(a_chars[i])
            middle.append(b_chars[i] - a_chars[i])
            out.append(b"".join((*parts, m_mark, t[lo:hi])))
        return n, form, prefix, middle, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in byte_list(batch.column(1))]
            for lo, hi in portions(texts, 1 << 22):
                n, form, prefix, middle, out = rows_of(ids[lo:hi], texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that was transformed, from the output and its form."""
    p, s, m = marks

    def between(start: str, stop: str) -> Column:
        return F.substring_index(F.substring_index(output, stop, 1), start, -1)
    middle = F.substring_index(output, m, -1)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
            .otherwise(F.concat(between(p, m), middle, between(s, p))))
