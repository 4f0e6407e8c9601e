"""Incremental ingest, scoring on a stream, and returns inside the window on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.measure import score_text
from tidemark.sources.raw_reviews import FILES, RAW, _name, add_files, numbered

LISTING = "path string, modificationTime timestamp, length long, content binary"


def ingest_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str,
                     columns: Sequence[str] = RAW[:4]) -> StreamingQuery:
    """Process the files that arrived since the last run, then stop.

    The stream lists files and reads no contents; each batch of them goes to the batch ingest, which finds columns by the
    header of each file, so layouts may differ, and refuses files without `columns`. Cities get numbers that never change. A
    batch that is repeated after a failure finds its cities written and adds nothing. The checkpoint remembers the files.
    """
    found = (spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", FILES).load(folder)
             .select(_name(F.col("_metadata.file_name")).alias("file"), F.col("length").alias("bytes"), "path"))

    def add(batch: DataFrame, _number: int) -> None:
        add_files(batch.sparkSession, numbered(batch), target, columns)

    return found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(texts: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Text scores of a stream of (review_id, comments); scoring keeps no state."""
    return (score_text(texts, "comments", **options).writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def returns_in_window(firsts: DataFrame, later: DataFrame, lag: str = "90 days", window: str = "730 days",
                      late: str = "1 day") -> DataFrame:
    """Reviews that follow a first review of the same reviewer inside the closed window.

    Streams of (reviewer_id, t0, listing_id) and (reviewer_id, review_id, ts, listing_id).
    State is bounded by the window: both sides carry watermarks and repeated reviews are
    dropped within them.
    """
    f = firsts.withWatermark("t0", late).select("reviewer_id", "t0", F.col("listing_id").alias("l0"))
    r = (later.withWatermark("ts", late).dropDuplicatesWithinWatermark(["review_id"])
         .select(F.col("reviewer_id").alias("_r"), "review_id", "ts", "listing_id"))
    inside = ((F.col("reviewer_id") == F.col("_r")) & (F.col("ts") >= F.col("t0") + F.expr(f"INTERVAL {lag}"))
              & (F.col("ts") <= F.col("t0") + F.expr(f"INTERVAL {window}")))
    return f.join(r, inside).select("reviewer_id", "review_id", "t0", "ts",
                                    (F.col("listing_id") == F.col("l0")).alias("same_listing"))
