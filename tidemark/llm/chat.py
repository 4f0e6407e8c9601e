"""Chat formatting by columnar byte assembly, with a loss mask over assistant texts.

A turn becomes `### Role: text</turn>\n`. The roles user, assistant and system are written with
a capital; any other role as `~` and its own text. Inside texts and roles a backslash stands
before every backslash, `#`, `<` and, in roles, `:`, so no control string can occur in them and
reading back is exact. Per Arrow batch the segments of all turns are laid out at once: lengths,
cumulative offsets and scatter indices in numpy, then every header and content byte is copied
into one buffer that becomes the Arrow column, cut where a conversation ends.

Conversations are streamed in order through sorted partitions, so one that holds a third of all
rows comes as many parts (`part` counts from 0) and is never held whole.

Defined results: null role and text are empty; a null conv_id is a conversation of its own; turns
with equal numbers follow by role, then text; repeated rows stay. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {v: k for k, v in NAMES.items()}
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PARTS = "conv_id long, part int, formatted string, loss_start array<int>, loss_length array<int>"


def escaped(column: pa.Array, marks: str) -> pa.Array:
    for m in "\\" + marks:
        column = pc.replace_substring(column, m, "\\" + m)
    return column


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    if role in NAMES:
        return OPEN + NAMES[role] + BETWEEN
    return OPEN + "~" + escaped(pa.array([role]), "#<:")[0].as_py() + BETWEEN


def _bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def assemble(segments: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with segment 0..m-1 of row 0, then of row 1 and so on; and where each segment begins.

    The second array has a row per input row and a column per segment.
    """
    parts = [_bytes_and_offsets(s) for s in segments]
    lengths = np.stack([np.diff(at) for _, at in parts], axis=1)
    starts = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.ravel(), out=starts[1:])
    out, begin = np.empty(starts[-1], np.uint8), starts[:-1].reshape(lengths.shape)
    for k, (data, at) in enumerate(parts):
        if at[-1] > at[0]:
            scatter = np.repeat(begin[:, k] - at[:-1], lengths[:, k]) + np.arange(at[0], at[-1])
            out[scatter] = data[at[0]:at[-1]]
    return out, begin


def format_chats(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) -> parts in order: conv_id, part, formatted, loss_start, loss_length.

    The two arrays mark the assistant texts of the part in code points, still escaped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = (), 0
        for b in batches:
            if not b.num_rows:
                continue
            roles, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            heads = {r: header(r) for r in set(roles)}
            texts = escaped(b.column(2).cast(pa.string()), "#<")
            head = pa.array([heads[r] for r in roles], pa.string())
            out, begin = assemble([head, texts, pa.array([CLOSE] * len(ids), pa.string())])
            edge = np.flatnonzero([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))])
            ends = [*edge[1:], len(ids)]
            cuts = np.append(begin[edge, 0], len(out)).astype(np.int64)
            formatted = pa.Array.from_buffers(pa.large_string(), len(edge), [None, pa.py_buffer(cuts), pa.py_buffer(out)])
            chars = np.zeros(len(out) + 1, np.int64)                    # code points before each byte
            np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
            first, stop = chars[begin[:, 1]], chars[begin[:, 2]]
            starts, lengths, numbers = [], [], []
            for lo, hi in zip(edge, ends):
                own = [i for i in range(lo, hi) if roles[i] == "assistant"]
                base = chars[begin[lo, 0]]
                starts.append([int(first[i] - base) for i in own])
                lengths.append([int(stop[i] - first[i]) for i in own])
                part = part + 1 if last == (ids[lo],) else 0
                last = (ids[lo],)
                numbers.append(part)
            whole = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in edge], pa.int64()), pa.array(numbers, pa.int32()),
                 formatted.cast(pa.string()), pa.array(starts, whole), pa.array(lengths, whole)],
                names=["conv_id", "part", "formatted", "loss_start", "loss_length"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ordered = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.select("conv_id", "role", "text").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from their parts in the order that `format_chats` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, done = None, []

        def close() -> None:
            if now:
                done.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]))

        for b in batches:
            for conv, part, text, starts, lengths in zip(*(c.to_pylist() for c in b.columns)):
                if part == 0:
                    close()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                now["size"] += len(text)
                at = 0
                for m in TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv} can't be read back at {at}")
                    at = m.end()
                    role = ROLES.get(m[1]) or unescaped(m[1].removeprefix("~"))
                    now["turns"].update(f"{role}\n{unescaped(m[2])}\n".encode())
                    now["n"] += 1
                if at != len(text):
                    raise ValueError(f"conversation {conv} has an unread end")
                for s, n in zip(starts, lengths):
                    loss = unescaped(text[s:s + n])
                    now["chars"] += len(loss)
                    now["loss"].update(loss.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names=names)
            done.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names=names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
