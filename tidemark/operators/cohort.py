"""First-event cohort with outcomes observed in a later window.

Input rows: review_id, reviewer_id, listing_id, city_id, date_i (days since 1970-01-01).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalar import PERIOD_END, PERIOD_START, in_hash_sample, in_period
from tidemark.operators.skew import HOT_MIN_ROWS, lookup_join, running_before, split_hot

KEYS = ["reviewer_id", "review_id", "listing_id", "city_id", "date_i"]
ORDER = ["date_i", "review_id", "city_id", "listing_id"]
# Copies of a row differ in their place in the listing only; the earlier one comes first.
COPY_ORDER = [*ORDER, "listing_prior_reviews"]


@dataclass(frozen=True)
class CohortRule:
    """Sampling, eligibility and outcome window; the defaults are the study's fixed values."""

    per_1000: int = 50
    lag_days: int = 90
    window_days: int = 730
    start_day: int | None = 14610       # 2010-01-01
    censor_day: int = 20619             # 2026-06-15
    period: tuple[str, str] = (PERIOD_START, PERIOD_END)
    lag_inclusive: bool = True


def drop_copies(reviews: DataFrame, key: str) -> DataFrame:
    """Optional: one row per `key`, the earliest. Copies are kept by default."""
    first = F.min(F.struct(*[c for c in ORDER if c != key], *[c for c in KEYS if c not in ORDER and c != key]))
    return reviews.groupBy(key).agg(first.alias("r")).select(key, "r.*").select(*KEYS)


def listing_context(reviews: DataFrame, hot_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Add listing_prior_reviews and listing_first_date, over all rows.

    Ordinary listings take one window. Listings holding a large share of the rows have
    their copies counted, are ranked over many tasks and written out again copy by copy, so
    both ways return the same rows.
    """
    per_listing = ["city_id", "listing_id"]
    base = reviews.select(*KEYS)
    cold, hot = split_hot(base, per_listing, min_rows=hot_rows)
    by_date = W.partitionBy(*per_listing).orderBy("date_i", "review_id", "reviewer_id")
    out = cold.select(
        *KEYS,
        (F.row_number().over(by_date) - 1).cast("long").alias("listing_prior_reviews"),
        F.first("date_i").over(by_date).alias("listing_first_date"))
    if hot is None:
        return out
    distinct = hot.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))
    firsts = hot.groupBy(*per_listing).agg(F.min("date_i").alias("listing_first_date"))
    ranked = running_before(distinct, ["date_i", "review_id", "reviewer_id"], ["copies"], within=per_listing)
    each = ranked.join(F.broadcast(firsts), per_listing).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.unionByName(each.select(
        *KEYS, (F.col("before_copies") + F.col("_copy") - 1).alias("listing_prior_reviews"), "listing_first_date"))


def sample_reviewers(reviews: DataFrame, per_1000: int) -> DataFrame:
    """All rows of a reproducible sample of reviewers."""
    return reviews if per_1000 >= 1000 else reviews.filter(in_hash_sample(F.col("reviewer_id"), per_1000))


def first_reviews(reviews: DataFrame) -> DataFrame:
    """The first row of every reviewer, by (date, review, city, listing)."""
    rest = [c for c in reviews.columns if c not in ORDER and c != "reviewer_id"]
    return (reviews.groupBy("reviewer_id").agg(F.min(F.struct(*ORDER, *rest)).alias("f"))
            .select("reviewer_id", "f.*").select(*reviews.columns))


def is_eligible(day: Column, rule: CohortRule) -> Column:
    """The whole window after the day is observed, and the day is not before the start."""
    ok = day <= F.lit(rule.censor_day - rule.window_days)
    return ok if rule.start_day is None else ok & (day >= F.lit(rule.start_day))


def in_window(gap: Column, rule: CohortRule) -> Column:
    lower = gap >= rule.lag_days if rule.lag_inclusive else gap > rule.lag_days
    return lower & (gap <= rule.window_days)


def with_outcomes(reviews: DataFrame, rule: CohortRule, hot_rows: int = HOT_MIN_ROWS,
                  counted_on: DataFrame | None = None) -> DataFrame:
    """First row of every eligible reviewer with n_future, n_future_same and days_to_next.

    Ordinary reviewers need one shuffle: first date and listing come from a window and
    the counts from a group-by on the same key. A reviewer with a large share of the
    rows is reduced by combinable aggregates instead, so no task receives the group.
    """
    cold, hot = split_hot(reviews, ["reviewer_id"], hot_rows, counted_on)
    ordered = W.partitionBy("reviewer_id").orderBy(*[c for c in COPY_ORDER if c in reviews.columns])
    marked = cold.select("*", F.row_number().over(ordered).alias("_rn"),
                         F.first("date_i").over(ordered).alias("_t0"),
                         F.first("listing_id").over(ordered).alias("_l0"))
    out = _outcome_counts(marked.filter(is_eligible(F.col("_t0"), rule)), reviews.columns, F.col("_rn") == 1, rule)
    if hot is None:
        return out
    firsts = F.broadcast(first_reviews(hot).select(
        "reviewer_id", *[F.col(c).alias(f"_f_{c}") for c in ORDER],
        F.col("date_i").alias("_t0"), F.col("listing_id").alias("_l0")))
    is_first = F.lit(True)
    for c in ORDER:
        is_first = is_first & (F.col(c) == F.col(f"_f_{c}"))
    seen = hot.join(firsts, "reviewer_id").filter(is_eligible(F.col("_t0"), rule))
    return out.unionByName(_outcome_counts(seen, reviews.columns, is_first, rule))


def _outcome_counts(rows: DataFrame, keep: list[str], is_first: Column, rule: CohortRule) -> DataFrame:
    gap = F.col("date_i") - F.col("_t0")
    later = in_window(gap, rule)
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    first = F.min(F.when(is_first, F.struct(*[c for c in keep if c != "reviewer_id"])))
    return (rows.groupBy("reviewer_id").agg(
        first.alias("f"),
        F.sum(F.when(later, one).otherwise(zero)).alias("n_future"),
        F.sum(F.when(later & (F.col("listing_id") == F.col("_l0")), one).otherwise(zero)).alias("n_future_same"),
        F.min(F.when(later, gap)).alias("days_to_next"))
        .select("reviewer_id", "f.*", "n_future", "n_future_same", "days_to_next"))


def focal_panel(reviews: DataFrame, rule: CohortRule = CohortRule(), hot_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """One row per eligible reviewer: first review, listing context, calendar and outcomes.

    The listing context needs every row, so the reviewer sample is taken after it.
    """
    context = sample_reviewers(listing_context(reviews, hot_rows), rule.per_1000)
    focal = with_outcomes(context, rule, hot_rows, counted_on=sample_reviewers(reviews, rule.per_1000))
    date = F.date_from_unix_date("date_i")
    return focal.select(
        "reviewer_id", "review_id", "listing_id", "city_id", date.alias("date"), "date_i",
        F.year(date).alias("year"), F.month(date).alias("month"),
        in_period(F.col("date_i"), *rule.period).alias("covid"),
        "listing_prior_reviews", (F.col("date_i") - F.col("listing_first_date")).alias("listing_age_days"),
        "n_future", "n_future_same", "days_to_next",
        (F.col("n_future_same") > 0).cast("int").alias("y_revisit"),
        (F.col("n_future") > 0).cast("int").alias("y_continue"))


def reviews_of(reviews: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of the reviewers in `cohort`, joined by its counted size."""
    return lookup_join(reviews, cohort.select("reviewer_id"), ["reviewer_id"], "left_semi")


def window_pairs(focal: DataFrame, reviews: DataFrame, rule: CohortRule, same_listing: bool = False) -> DataFrame:
    """Each focal row with each later review of the same reviewer inside the window.

    There is one focal row per reviewer, so the result never exceeds the reviews and the
    focal rows serve as a lookup.
    """
    f = focal.select("reviewer_id", F.col("date_i").alias("t0"), F.col("listing_id").alias("l0"))
    later = reviews.select("reviewer_id", "review_id", "listing_id", "date_i")
    pairs = lookup_join(later, f, ["reviewer_id"], "inner").withColumn("gap", F.col("date_i") - F.col("t0"))
    pairs = pairs.filter(in_window(F.col("gap"), rule))
    return pairs.filter(F.col("listing_id") == F.col("l0")) if same_listing else pairs


def panel_summary(sampled: DataFrame, focal: DataFrame, rule: CohortRule) -> DataFrame:
    """One row of run metadata: counts, base rates and the constants used."""
    left = sampled.agg(F.count(F.lit(1)).alias("total_sampled_reviews"),
                       F.countDistinct("reviewer_id").alias("sampled_reviewers"))
    right = focal.agg(F.count(F.lit(1)).alias("eligible_focal"), F.avg("y_revisit").alias("y_revisit_rate"),
                      F.avg("y_continue").alias("y_continue_rate"))
    return left.join(F.broadcast(right)).select(   # one row each
        "*", F.lit(rule.per_1000).alias("sample_per_1000"), F.lit(rule.lag_days).alias("lag_days"),
        F.lit(rule.window_days).alias("window_days"))


def estimated_reviewers(sampled: DataFrame, per_1000: int) -> DataFrame:
    """Distinct sampled reviewers, scaled up by the sampling rate."""
    n = F.countDistinct("reviewer_id")
    return sampled.agg(n.alias("sampled_reviewers"),
                       (n * F.lit(1000) / F.lit(per_1000)).cast("long").alias("estimated_reviewers"))
