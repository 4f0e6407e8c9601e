"""Views over the given tables that stand for the review corpus, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.cohort import CohortRule, focal_panel
from tidemark.operators.measure import score_text
from tidemark.session import require_checkpoint_dir
from tidemark.sources.tables import spread_if_few, write_table

# Phrases with known construct content, appended by doc_id % 8.
PHRASES = (
    " We loved the place and would definitely come back. Highly recommended!",
    " Easy check-in was smooth; we could walk. Perfect stay, no complaints.",
    " My friends told us about it<br/>and we will be back next time!!",
    " Uneasy but comfortable. Exactly as described, exceeded our expectations.",
    " This is an automated posting.",
    " Hope to return.",
    " Convenient, responsive and lovely; I'll be back.",
    "",
)
# The view's last day is 2001-08-01. Everybody is sampled: a 5 % sample leaves too few rows here.
VIEW_RULE = CohortRule(per_1000=1000, start_day=None, censor_day=11535, period=("1995-07-01", "1996-06-30"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder."""
    require_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with line items; listing = smallest supplier, city = its nation."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("listing_id"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("reviewer_id"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("date_i"))
    cities = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("listing_id"), F.col("s_nationkey").alias("city_id"))
    return (orders.join(lines, orders.review_id == lines.l_orderkey).drop("l_orderkey")
            .join(cities, "listing_id").select("review_id", "reviewer_id", "listing_id", "city_id", "date_i"))


def city_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"))


def augmented(docs: DataFrame) -> DataFrame:
    """Also for a stream of documents."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return docs.select("doc_id", "source", F.concat("text", phrase).alias("text"))


def aug_documents(spark: SparkSession, sf: str) -> DataFrame:
    return augmented(spread_if_few(table(spark, sf, "documents")))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return score_text(aug_documents(spark, sf), "text", keep=["doc_id"])


def focal(spark: SparkSession, sf: str) -> DataFrame:
    """The panel reads its rows several times (hot listings, hot reviewers, the windows), so they are a written table, as in a study."""
    path = scratch(spark)
    write_table(reviews(spark, sf), path)
    return focal_panel(spark.read.parquet(path), VIEW_RULE)


_ANALYSIS: dict[tuple[str, str], DataFrame] = {}


def analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Cohort x text scores x city name; the review text is document review_id % count(documents).

    Planned once per session and kept, because most models read their rows several times.
    In a study it is a written table.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ANALYSIS:
        docs = table(spark, sf, "documents").count()
        rows = focal(spark, sf).withColumn("doc_id", F.col("review_id") % F.lit(docs))
        _ANALYSIS[key] = rows.join(features(spark, sf), "doc_id").join(F.broadcast(city_names(spark, sf)), "city_id")
    return _ANALYSIS[key].persist()
