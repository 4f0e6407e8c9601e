"""Parquet, CSV and JSON tables, and the ledger of finished results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def spread_if_few(df: DataFrame) -> DataFrame:
    """Use every core when fewer splits of the scan hold rows than there are cores, as with one file of one row group.

    A large file has as many splits as cores, but a row group is read by one of them only. The rows of every split are
    counted, for which no column is read. Inputs whose splits are near even are left as they are, without a shuffle.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    held = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    largest, total = held.agg(F.max("n"), F.sum("n")).first()
    if splits >= cores and largest is not None and largest * cores <= 2 * total:
        return df
    # Dealt by the row's place, which needs no sort of whole rows and no key that varies.
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(max(cores, splits), "_place").drop("_place")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header; results are small by design."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_run_metadata(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def empty_table(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None before anything was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class Ledger:
    """Append-only result table; a key already present is not computed again."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)

    def table(self) -> DataFrame | None:
        return read_if_written(self.spark, self.path)

    def done(self) -> set[tuple]:
        """Keys of the stored results: one per model or effect."""
        table = self.table()
        return set() if table is None else {tuple(r) for r in table.select(*self.keys).distinct().collect()}

    def pending(self, wanted: DataFrame) -> DataFrame:
        table = self.table()
        return wanted if table is None else wanted.join(table.select(*self.keys), self.keys, "left_anti")

    def append(self, results: DataFrame) -> None:
        self.pending(results).write.mode("append").parquet(self.path)
