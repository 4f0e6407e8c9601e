"""Helpers shared by the corpus operators: Arrow columns, folds, hubs streamed ahead of their spokes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(c: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % folds, F.lit(0))


def byte_list(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes; `bytes.split` and `bytes.lower` then follow the ASCII rules used here."""
    return column.cast(pa.binary()).to_pylist()


def compress(texts: pa.Array) -> pa.Array:
    """Each text as zstandard bytes; null where it is null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if t is None else pack(t) for t in byte_list(texts)], pa.binary())


def compressed(rows: DataFrame, id_col: str) -> DataFrame:
    """A long id and its text as zstandard bytes, for joins that shuffle texts; a null text stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), compress(b.column(1))], names=[id_col, "text"])
    return rows.select(id_col, "text").mapInArrow(run, f"`{id_col}` long, text binary")


def opened(column: pa.Array) -> list[bytes]:
    """Texts from what `compressed` made; empty where null."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) if t else b"" for t in column.to_pylist()]


def hubs_and_spokes(hubs: DataFrame, spokes: DataFrame, per_task: int = 20_000) -> DataFrame:
    """Rows of `hubs` ahead of the rows of `spokes` with the same `hub`, in partitions sorted for streaming.

    Both hold a long `hub` besides the same columns. A hub with more than `per_task` spokes is
    split over salts by a hash of the spoke's columns other than text, so a repeated task deals rows as before: the hub's
    own rows are repeated for each salt, and no task gets all its spokes.
    Returns columns hub, salt, side (0 hub, 1 spoke) and the rest.
    """
    sizes = (spokes.groupBy("hub").agg(F.count(F.lit(1)).alias("_n"))
             .select("hub", F.ceil(F.col("_n") / per_task).cast("int").alias("_salts")))
    rest = [c for c in hubs.columns if c != "hub"]
    many = sizes.where("_salts > 1")
    hub_rows = (hubs.join(sizes, "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
                .select("hub", "salt", F.lit(0).alias("side"), *rest))
    # Only hubs over the limit are looked up; the join's spoke side can be split by AQE.
    spoke_rows = (spokes.join(many, "hub", "left")
                  .withColumn("salt", F.when(F.col("_salts").isNull(), 0)
                              .otherwise(F.pmod(F.xxhash64(*[c for c in rest if c != "text"]), F.col("_salts")).cast("int")))
                  .select("hub", "salt", F.lit(1).alias("side"), *rest))
    return (hub_rows.unionByName(spoke_rows).repartition("hub", "salt")
            .sortWithinPartitions("hub", "salt", "side"))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces_of(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))
