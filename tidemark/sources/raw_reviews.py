"""Raw review files: one CSV (plain or gzip) per city, columns found by name."""

from __future__ import annotations

import csv
import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.scalar import slug, to_day, to_whole_number
from tidemark.sources.split_csv import odd_files, records, survey
from tidemark.sources.tables import read_if_written

log = logging.getLogger(__name__)
RAW = ["listing_id", "id", "date", "reviewer_id", "comments"]
META = ["listing_id", "review_id", "reviewer_id", "date_i", "city_id"]
OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "mode": "PERMISSIVE"}
FILES = "*.{csv,csv.gz}"


def _name(encoded: Column) -> Column:
    """File name as written on disk; only % escapes are undone."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """(city_id, city, slug, file, bytes, path): files in name order, numbered from 0. Contents are not read."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(folder)
             .select(_name(F.col("_metadata.file_name")).alias("file"), F.col("length").alias("bytes"), "path"))
    return numbered(found)


def numbered(found: DataFrame) -> DataFrame:
    """A registry of files (file, bytes, path)."""
    number = (F.row_number().over(W.orderBy("file")) - 1).cast("int")        # one row per file
    city = F.regexp_replace("file", r"\.csv(\.gz)?$", "")
    return found.select(number.alias("city_id"), city.alias("city"), slug(city).alias("slug"), "file", "bytes", "path")


def _file(path: Column) -> Column:
    return _name(F.element_at(F.split(path, "/"), -1))


def headers(paths: Sequence[str], blocks: DataFrame, wanted: Sequence[str] = RAW) -> tuple[dict[str, tuple[str, ...]], dict[str, str]]:
    """Header of every file that has the wanted columns, and the reason for every other one. No file is read: `blocks` holds first lines."""
    heads = {r["file"]: r["head"] for r in blocks.where("head IS NOT NULL").select(_file(F.col("path")).alias("file"), "head").collect()}
    found, refused = {}, {}
    for path in paths:                                       # one row per file
        head = heads.get(path.rsplit("/", 1)[-1])
        names = tuple(next(csv.reader([(head or "").removeprefix("\ufeff").rstrip("\r")]), ()))
        missing = [c for c in wanted if c not in names]
        if head is None:
            refused[path] = "empty"
        elif missing:
            refused[path] = f"no column {', '.join(missing)}"
        elif head.count('"') % 2:
            refused[path] = "the header has a line break"
        else:
            found[path] = names
    for path, why in refused.items():
        log.warning("left out %s: %s", path, why)
    return found, refused


def layouts(spark: SparkSession, paths: Sequence[str], wanted: Sequence[str] = RAW, blocks: DataFrame | None = None) -> dict[str, tuple[str, ...]]:
    """Header of every file that has the wanted columns; other files are reported and left out. One job for all files."""
    return headers(paths, survey(spark, paths) if blocks is None else blocks, wanted)[0]


def scan(spark: SparkSession, files: Mapping[str, Sequence[str]], wanted: Sequence[str] = RAW, blocks: DataFrame | None = None) -> DataFrame:
    """The wanted columns of the files (path -> header) as text, with the file name.

    A file is read in ranges by many tasks, all layouts in one scan. Long rows are cut and short ones padded with nulls. A file
    whose quotes don't pair is read by one task.
    """
    blocks = survey(spark, list(files)) if blocks is None else blocks
    unpaired = {r["file"] for r in odd_files(blocks).select(_file(F.col("path")).alias("file")).collect()}
    parts = [spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*wanted, "file"]))]
    split = {p: names for p, names in files.items() if p.rsplit("/", 1)[-1] not in unpaired}
    if split:
        at = {p.rsplit("/", 1)[-1]: [list(names).index(c) for c in wanted] for p, names in split.items()}
        places = spark.createDataFrame(list(at.items()), "file string, places array<int>")                # one row per file
        width = max(map(len, split.values()))
        fields = F.from_csv("record", ", ".join(f"c{k} string" for k in range(width)), {k: v for k, v in OPTIONS.items() if k != "header"})
        rows = (records(spark, list(split), blocks, at).select(_file(F.col("path")).alias("file"), fields.alias("_row"), "cells")
                .select("file", F.array(*[F.col(f"_row.c{k}") for k in range(width)]).alias("_cells"), "cells").join(F.broadcast(places), "file"))
        parts.append(rows.select(*[F.when(F.col("cells").isNotNull(), F.get("cells", F.lit(k))).otherwise(F.get("_cells", F.col("places")[k])).alias(c)
                                   for k, c in enumerate(wanted)], "file"))
    for path in files.keys() - split.keys():
        schema = StructType([StructField(c, StringType()) for c in files[path]])
        rows = spark.read.schema(schema).options(**OPTIONS).csv(path)
        parts.append(rows.select(*wanted, _name(F.col("_metadata.file_name")).alias("file")))
    return reduce(DataFrame.unionByName, parts)


def with_city(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Add city_id by file name; the registry has one row per file."""
    return rows.join(F.broadcast(cities.select("file", "city_id")), "file")


def coerce(rows: DataFrame) -> DataFrame:
    """Typed metadata rows; anything that is not a number or a date becomes null. Ids stay exact."""
    return rows.select(
        to_whole_number(F.col("listing_id")).alias("listing_id"), to_whole_number(F.col("id")).alias("review_id"),
        to_whole_number(F.col("reviewer_id")).alias("reviewer_id"), to_day(F.col("date")).alias("date_i"), "city_id")


def metadata(rows: DataFrame) -> DataFrame:
    """Rows with every id and the date present."""
    return coerce(rows).dropna(subset=META).select(*META)


def rejects(rows: DataFrame) -> DataFrame:
    """Rows read and dropped per city."""
    bad = F.lit(False)
    for c in META[:4]:
        bad = bad | F.col(c).isNull()
    return coerce(rows).groupBy("city_id").agg(F.count(F.lit(1)).alias("n_read"), F.count_if(bad).alias("n_dropped"))


def texts(rows: DataFrame) -> DataFrame:
    """(city_id, review_id, reviewer_id, comments) of the rows with a numeric id."""
    return rows.select("city_id", to_whole_number(F.col("id")).alias("review_id"),
                       to_whole_number(F.col("reviewer_id")).alias("reviewer_id"), "comments").filter(
        F.col("review_id").isNotNull())


def ingest(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Write the metadata of the cities not yet in `target`, one partition per city; return the table.

    Text is not read. Dynamic partition overwrite makes a re-run of a half-written city
    replace it; a city enters the written registry only after its rows are there, and an
    unreadable file is tried again next time. Files that arrive later are numbered after
    the known ones, so no number ever changes. Rows read and dropped per city are kept in
    `target`.rejects, files left out in the last call and why in `target`.refused.
    """
    add_files(spark, registry(spark, folder), target)
    return spark.read.parquet(target).select(*META)


def add_files(spark: SparkSession, cities: DataFrame, target: str, wanted: Sequence[str] = RAW[:4]) -> None:
    """`ingest` for the files of a registry; those that `target` has already add nothing."""
    known = read_if_written(spark, f"{target}.cities")
    if known is not None:
        last = known.agg(F.max("city_id")).first()[0]
        number = F.row_number().over(W.orderBy("file")) + F.lit(last)
        cities = (cities.join(F.broadcast(known.select("file")), "file", "left_anti")
                  .withColumn("city_id", number.cast("int")))
    todo = cities.select("city_id", "city", "slug", "file", "bytes", "path").collect()       # one row per file
    blocks = survey(spark, [r["path"] for r in todo])
    readable, refused = headers([r["path"] for r in todo], blocks, wanted)
    (spark.createDataFrame([(r["file"], refused[r["path"]]) for r in todo if r["path"] in refused], "file string, reason string")
     .coalesce(1).write.mode("overwrite").parquet(f"{target}.refused"))
    todo = [r for r in todo if r["path"] in readable]
    if todo:
        listed = spark.createDataFrame(todo, "city_id int, city string, slug string, file string, bytes long, path string")
        rows = with_city(scan(spark, readable, RAW[:4], blocks), listed)
        (metadata(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("city_id").parquet(target))
        _write_rejects(spark, listed, readable, blocks, target)
        listed.coalesce(1).write.mode("append").parquet(f"{target}.cities")


def _write_rejects(spark: SparkSession, listed: DataFrame, readable: Mapping[str, Sequence[str]], blocks: DataFrame, target: str) -> None:
    """Counts of records come from the survey, kept rows from the footers of the written table; only files with unpaired quotes are read again."""
    unpaired = [r["file"] for r in odd_files(blocks).select(_file(F.col("path")).alias("file")).collect()]
    read = (blocks.groupBy(_file(F.col("path")).alias("file")).agg((F.sum("n_records") - 1).alias("n_read"))
            .where(~F.col("file").isin(unpaired)).join(F.broadcast(listed.select("file", "city_id")), "file"))
    kept = spark.read.parquet(target).groupBy("city_id").agg(F.count(F.lit(1)).alias("_kept"))
    counts = read.join(kept, "city_id", "left").select("city_id", "n_read", (F.col("n_read") - F.coalesce("_kept", F.lit(0))).alias("n_dropped"))
    again = {p: names for p, names in readable.items() if p.rsplit("/", 1)[-1] in unpaired}
    if again:
        counts = counts.unionByName(rejects(with_city(scan(spark, again, RAW[:4], blocks), listed)).select(*counts.columns))
    (counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city_id").parquet(f"{target}.rejects"))


def written_registry(spark: SparkSession, target: str) -> DataFrame:
    """The cities ingested into `target`, with the numbers they were given."""
    return spark.read.parquet(f"{target}.cities")
