"""Multi-line CSV files read in byte ranges, so that one large file is the work of many tasks.

A line break belongs to a field when an odd number of quotes comes before it in the file (a quote inside a field is
doubled). `survey` counts the quotes of every range in one pass; their running parity says which ranges begin inside a
field. `records` then reads the ranges again, puts lines together within each, and joins the pieces of records that
cross a border, at most two a range.

Defined results: the header is the first line of a file. Blank lines between records are left out, as is a carriage return
at a record's end. A gzip file is one range. Files in which quotes stand unpaired (`odd_files`) can't be read this way.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.session import checkpointed

BLOCKS = "path string, start long, odd int, plain long, inner long, head string"
LINES = "path string, start long, kind int, record string, cells array<string>"
MAX_RANGES = 1_000_000                          # 128 TB at the usual 128 MB a range
WHOLE, OPENS, GOES_ON, CLOSES = range(4)


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value, path, start of the range) of every line, in order within a range."""
    meta = F.col("_metadata")
    return (spark.read.option("lineSep", "\n").text(list(paths))
            .select("value", meta["file_path"].alias("path"), meta["file_block_start"].alias("start")))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """(path, start, lines, whether each has an odd number of quotes) of the ranges in a batch."""
    if not b.num_rows:
        return
    odd = np.asarray(pc.count_substring(b.column(0), '"')) & 1
    path, start = b.column(1), np.asarray(b.column(2))
    new = np.asarray(pc.not_equal(path[1:], path[:-1]).cast(pa.int8())).astype(bool) | (start[1:] != start[:-1])
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
    for i, j in zip(edges, edges[1:]):
        yield path[i].as_py(), int(start[i]), b.column(0)[i:j], odd[i:j]


def survey(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per range: path, start, inside (it begins inside a field), n_records that begin in it, odd, head (the first line of a file)."""
    if not paths:
        return spark.createDataFrame([], "path string, start long, inside boolean, n_records long, odd int, head string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for b in batches:
            done = []
            for path, start, lines, odd in _runs(b):
                if now is None or now[:2] != [path, start]:
                    done += [now] if now else []
                    now = [path, start, 0, 0, 0, lines[0].as_py() if start == 0 else None]
                before = (now[2] + np.cumsum(odd) - odd) & 1
                filled = (np.asarray(pc.binary_length(lines)) > 0) & ~np.asarray(pc.equal(lines, "\r").cast(pa.int8())).astype(bool)
                now[3] += int((filled & (before == 0)).sum())
                now[4] += int((filled & (before == 1)).sum())
                now[2] = int(now[2] + odd.sum()) & 1
            if done:
                yield _batch(done)
        if now:
            yield _batch([now])

    def _batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    blocks = _lines(spark, paths).mapInArrow(count, BLOCKS)
    earlier = F.sum("odd").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1))     # a row per range
    inside = F.coalesce(earlier % 2 == 1, F.lit(False))
    # One quote that is odd before a range turns both states of it round.
    return checkpointed(blocks.withColumn("inside", inside).select(
        "path", "start", "inside", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("plain")).alias("n_records"), "odd", "head"))


def odd_files(blocks: DataFrame) -> DataFrame:
    """Paths of the files whose quotes don't pair."""
    return blocks.groupBy("path").agg(F.bit_xor("odd").alias("odd")).where("odd = 1").select("path")


def cells_of(record: str, places: Sequence[int]) -> list[str | None] | None:
    """The fields at `places` of a record that is plain, up to a last field in quotes; None where a CSV parser has to look at it."""
    if not record[:1] > " " or "\r" in record or "\0" in record:
        return None
    at = record.find('"')
    if at < 0:
        cells = record.split(",")
    else:
        inner = record[at + 1:-1]
        if not inner or record[-1] != '"' or (at and record[at - 1] != ",") or '"' in inner.replace('""', ""):
            return None
        cells = record[:at].split(",")
        cells[-1] = inner.replace('""', '"')
    return [(cells[k] or None) if k < len(cells) else None for k in places]


def records(spark: SparkSession, paths: Sequence[str], blocks: DataFrame, places: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """(path, record) of every record but the headers, as CSV text. With `places`, the wanted columns by file name, (path,
    record, cells): records that `cells_of` reads have their cells only, so that a parser sees few and fields not wanted go nowhere.

    `blocks` (from `survey`) is broadcast up to MAX_RANGES rows; it has one per `spark.sql.files.maxPartitionBytes` of input.
    """
    if blocks.count() > MAX_RANGES:
        raise ValueError("more ranges than can be broadcast: raise spark.sql.files.maxPartitionBytes or read fewer files at once")
    if not paths:
        return spark.createDataFrame([], "path string, record string" + ", cells array<string>" * (places is not None))
    lines = _lines(spark, paths)
    ends_inside = F.coalesce(F.lead("inside").over(W.partitionBy("path").orderBy("start")), F.lit(False))         # a row per range
    border = blocks.select("path", "start", "inside", ends_inside.alias("_ends")).where("inside OR _ends").select("path", "start", "inside")
    several = bool(border.take(1))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, kind, parts, wanted = None, False, WHOLE, [], None

        def whole(text: str) -> tuple:
            cells = None if wanted is None else cells_of(text, wanted)
            return *at, WHOLE, text if cells is None else None, cells
        for b in batches:
            out: list[tuple] = []
            offset = 0
            for path, start, lines_, odd in _runs(b):
                inside = b.column(3)[offset].as_py()
                offset += len(lines_)
                if (path, start) != at:
                    if open_:
                        out.append((*at, OPENS if kind == WHOLE else GOES_ON, "\n".join(parts), None))
                    if inside is None:
                        raise RuntimeError(f"{path} was cut otherwise when it was read again")
                    at, open_, parts = (path, start), inside, []
                    wanted = None if places is None else places[unquote(path.rsplit("/", 1)[-1])]
                    kind = GOES_ON if inside else WHOLE
                    if start == 0:                              # the header
                        lines_, odd = lines_[1:], odd[1:]
                before = (int(open_) + np.cumsum(odd) - odd) & 1
                simple = (before == 0) & (odd == 0)
                for text in lines_.filter(pa.array(simple)).to_pylist():
                    if text not in ("", "\r"):
                        out.append(whole(text))
                rest = ~simple
                for text, turns in zip(lines_.filter(pa.array(rest)).to_pylist(), odd[rest].tolist()):
                    parts.append(text)
                    if not open_:
                        open_ = True
                    elif turns:
                        text = "\n".join(parts)
                        out.append((*at, CLOSES, text, None) if kind == GOES_ON else whole(text))
                        open_, kind, parts = False, WHOLE, []
            if out:
                yield _batch(out)
        if open_:
            yield _batch([(*at, OPENS if kind == WHOLE else GOES_ON, "\n".join(parts), None)])

    def _batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in LINES.split(", ")])

    # What a range's first byte lies in depends on the file alone, so ranges cut otherwise than surveyed are noticed, not misread.
    known = F.broadcast(blocks.select("path", "start", "inside"))
    found = lines.join(known, ["path", "start"], "left").select("value", "path", "start", "inside").mapInArrow(assemble, LINES)
    told = [] if places is None else ["cells"]
    complete = found.where(F.col("kind") == WHOLE).select("path", F.regexp_replace("record", r"\r\z", "").alias("record"), *told)
    if not several:
        return complete
    # Pieces are looked for in ranges whose border cuts a field; no other range gets to Python a second time.
    cut = lines.join(F.broadcast(border), ["path", "start"]).select("value", "path", "start", "inside")
    pieces = cut.mapInArrow(assemble, LINES).where(F.col("kind") != WHOLE)
    number = F.sum((F.col("kind") == OPENS).cast("int")).over(W.partitionBy("path").orderBy("start", F.desc("kind")))
    joined = (pieces.withColumn("_no", number).groupBy("path", "_no")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.negate("kind").alias("k"), "record"))),
                                            lambda p: p["record"]), "\n").alias("record")))
    none = [F.lit(None).cast("array<string>").alias(c) for c in told]
    return complete.unionByName(joined.select("path", F.regexp_replace("record", r"\r\z", "").alias("record"), *none))
