"""Cohort, calendar, join and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import inputs as I
from catalog.registry import query
from catalog.sql import using
from tidemark.functions import scalar as sc
from tidemark.operators import cohort as co, order_stats as os_
from tidemark.operators.skew import lookup_join


@query("first_event_panel", using("focal", body="""
    SELECT reviewer_id, review_id, listing_id, city_id::BIGINT AS city_id, date, date_i, year, month, covid::BIGINT AS covid,
           listing_prior_reviews, listing_age_days, n_future, n_future_same, days_to_next,
           y_revisit::BIGINT AS y_revisit, y_continue::BIGINT AS y_continue FROM focal"""))
def first_event_panel(spark: SparkSession, sf: str) -> DataFrame:
    """W5, W3, J3, J4, A1, A2: the cohort with context, calendar and outcomes."""
    return I.focal(spark, sf)


@query("city_return_rates_a11", using("focal", body="""
    SELECT n_name AS city, count(*) AS n, round(100 * avg(y_revisit), 2) AS y1, round(100 * avg(y_continue), 1) AS y2
    FROM focal JOIN nation ON n_nationkey = city_id GROUP BY n_name"""))
def city_return_rates(spark, sf):
    from tidemark.operators.describe import city_coverage
    return city_coverage(I.focal(spark, sf).join(F.broadcast(I.city_names(spark, sf)), "city_id"))


@query("hash_sample_x1", using("reviews", body="""
    SELECT review_id, reviewer_id, ((reviewer_id * 2654435761) % 4294967296) AS hash32 FROM reviews
    WHERE ((reviewer_id * 2654435761) % 4294967296) % 1000 < 50"""))
def hash_sample(spark, sf):
    kept = co.sample_reviewers(I.reviews(spark, sf), 50)
    return kept.select("review_id", "reviewer_id", sc.hash32(F.col("reviewer_id")).alias("hash32"))


@query("calendar_parts_x2_x4_x5", using("reviews", body="""
    SELECT review_id, date_i, year(d) AS year, month(d) AS month,
           CASE WHEN d BETWEEN DATE '1996-03-11' AND DATE '1998-05-05' THEN 1 ELSE 0 END::BIGINT AS in_period
    FROM (SELECT *, DATE '1970-01-01' + CAST(date_i AS INTEGER) AS d FROM reviews)"""))
def calendar_parts(spark, sf):
    d = F.date_from_unix_date("date_i")
    return I.reviews(spark, sf).select("review_id", "date_i", F.year(d).alias("year"), F.month(d).alias("month"),
                                       sc.in_period(F.col("date_i"), "1996-03-11", "1998-05-05").alias("in_period"))


@query("eligible_firsts_x3_w3", using("firsts", body="""
    SELECT reviewer_id, review_id, date_i FROM firsts WHERE date_i >= 9131 + 30 AND date_i <= 11535 - 730"""))
def eligible_firsts(spark, sf):
    rule = co.CohortRule(per_1000=1000, start_day=9161, censor_day=11535)
    firsts = co.first_reviews(I.reviews(spark, sf))
    return firsts.filter(co.is_eligible(F.col("date_i"), rule)).select("reviewer_id", "review_id", "date_i")


@query("listing_context_w1_w2_x6", using("ctx", body="""
    SELECT review_id, listing_prior_reviews, date_i - listing_first_date AS listing_age_days FROM ctx"""))
def listing_context(spark, sf):
    return co.listing_context(I.reviews(spark, sf)).select(
        "review_id", "listing_prior_reviews", (F.col("date_i") - F.col("listing_first_date")).alias("listing_age_days"))


@query("eligible_reviewers_rows_j2", using("eligible", body="""
    SELECT review_id, reviewer_id FROM reviews WHERE reviewer_id IN (SELECT reviewer_id FROM eligible)"""))
def eligible_reviewers_rows(spark, sf):
    reviews = I.reviews(spark, sf)
    firsts = co.first_reviews(reviews).filter(co.is_eligible(F.col("date_i"), I.VIEW_RULE))
    return co.reviews_of(reviews, firsts).select("review_id", "reviewer_id")


@query("window_pairs_j5", using("pairs", body="""
    SELECT reviewer_id, review_id, gap, CAST(listing_id = l0 AS BIGINT) AS same_listing FROM pairs"""))
def window_pairs(spark, sf):
    reviews = I.reviews(spark, sf)
    firsts = co.first_reviews(reviews).filter(co.is_eligible(F.col("date_i"), I.VIEW_RULE))
    return co.window_pairs(firsts, reviews, I.VIEW_RULE).select(
        "reviewer_id", "review_id", "gap", (F.col("listing_id") == F.col("l0")).cast("long").alias("same_listing"))


@query("outcome_counts_a1", using("counts", body="SELECT * FROM counts"))
def outcome_counts(spark, sf):
    found = co.with_outcomes(I.reviews(spark, sf), I.VIEW_RULE).filter(F.col("n_future") > 0)
    return found.select("reviewer_id", "n_future", "n_future_same", "days_to_next")


@query("base_rates_a2", using("focal", body="""
    SELECT count(*) AS n, round(avg(y_revisit), 6) AS y1, round(avg(y_continue), 6) AS y2 FROM focal"""))
def base_rates(spark, sf):
    return I.focal(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg("y_revisit").alias("y1"),
                                  F.avg("y_continue").alias("y2"))


@query("events_returns_a1", """
    WITH e AS (SELECT user_id, event_id, event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d FROM events),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d, event_id) = 1)
    SELECT f.user_id, count(*) FILTER (WHERE e.d - f.d BETWEEN 2 AND 14) AS n_future,
           count(*) FILTER (WHERE e.d - f.d BETWEEN 2 AND 14 AND e.event_type = f.event_type) AS n_future_same
    FROM f JOIN e ON e.user_id = f.user_id WHERE f.d <= 19752 - 14 GROUP BY f.user_id""")
def events_returns(spark, sf):
    """The same cohort over the event log: user, event type, 2 to 14 days."""
    ev = I.table(spark, sf, "events").select(
        F.col("user_id").alias("reviewer_id"), F.col("event_id").alias("review_id"), F.lit(0).alias("city_id"),
        F.col("event_type").alias("listing_id"), F.unix_date(F.col("ts").cast("date")).alias("date_i"))
    rule = co.CohortRule(per_1000=1000, lag_days=2, window_days=14, start_day=None, censor_day=19752)
    return co.with_outcomes(ev, rule).select(F.col("reviewer_id").alias("user_id"), "n_future", "n_future_same")


@query("scaled_up_reviewers_a16", using("reviews", body="""
    SELECT count(DISTINCT reviewer_id) AS sampled_reviewers, count(DISTINCT reviewer_id) * 20 AS estimated_reviewers
    FROM reviews WHERE ((reviewer_id * 2654435761) % 4294967296) % 1000 < 50"""))
def scaled_up_reviewers(spark, sf):
    return co.estimated_reviewers(co.sample_reviewers(I.reviews(spark, sf), 50), 50)


@query("run_metadata_s8", using("focal", body="""
    SELECT (SELECT count(*) FROM reviews) AS total_sampled_reviews,
           (SELECT count(DISTINCT reviewer_id) FROM reviews) AS sampled_reviewers, count(*) AS eligible_focal,
           round(avg(y_revisit), 6) AS y_revisit_rate, round(avg(y_continue), 6) AS y_continue_rate,
           1000::BIGINT AS sample_per_1000, 90::BIGINT AS lag_days, 730::BIGINT AS window_days FROM focal"""))
def run_metadata(spark, sf):
    return co.panel_summary(I.reviews(spark, sf), I.focal(spark, sf), I.VIEW_RULE)


@query("distinct_cities_a15", using("focal", body="SELECT count(DISTINCT city_id) AS cities FROM focal"))
def distinct_cities(spark, sf):
    return I.focal(spark, sf).agg(F.countDistinct("city_id").alias("cities"))


@query("city_stats_a14", using("reviews", body="""
    SELECT city_id::BIGINT AS city_id, count(*) AS n, DATE '1970-01-01' + CAST(min(date_i) AS INTEGER) AS date_min,
           DATE '1970-01-01' + CAST(max(date_i) AS INTEGER) AS date_max FROM reviews GROUP BY city_id"""))
def city_stats(spark, sf):
    from tidemark.operators.describe import city_stats as stats
    return stats(I.reviews(spark, sf))


@query("pseudonyms_x17", using("focal", body="""
    SELECT review_id, substr(sha256('tidemark' || reviewer_id::VARCHAR), 1, 16) AS reviewer FROM focal"""))
def pseudonyms(spark, sf):
    return I.focal(spark, sf).select("review_id", sc.pseudonym(F.col("reviewer_id"), "tidemark").alias("reviewer"))


@query("city_rate_lookup_j3", using("focal", body="""
    SELECT f.review_id, round(coalesce(r.rate, p.prior), 6) AS rate FROM focal f CROSS JOIN p
    LEFT JOIN r ON r.city_id = f.city_id""", extra={
    "p": "SELECT avg(y_revisit) AS prior FROM focal",
    "r": "SELECT city_id, avg(y_revisit) AS rate FROM focal WHERE year <= 1995 GROUP BY city_id HAVING count(*) >= 40"}))
def city_rate_lookup(spark, sf):
    f = I.focal(spark, sf)
    prior = f.agg(F.avg("y_revisit")).first()[0]
    rates = (f.filter(F.col("year") <= 1995).groupBy("city_id")
             .agg(F.avg("y_revisit").alias("rate"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 40).drop("n"))
    return lookup_join(f, rates, ["city_id"]).select("review_id", F.coalesce("rate", F.lit(prior)).alias("rate"))


@query("first_copy_kept_g16", using("reviews", body="""
    SELECT reviewer_id, review_id, date_i FROM (SELECT * FROM reviews UNION ALL SELECT * FROM reviews)
    QUALIFY row_number() OVER (PARTITION BY reviewer_id ORDER BY date_i, review_id, city_id, listing_id) = 1"""))
def first_copy_kept(spark, sf):
    r = I.reviews(spark, sf)
    return co.first_reviews(co.drop_copies(r.unionByName(r), "review_id")).select("reviewer_id", "review_id", "date_i")


@query("seeded_sample_o4", using("focal", body="""
    SELECT reviewer_id, review_id FROM focal
    ORDER BY ((reviewer_id + 20260901) * 2654435761) % 4294967296, reviewer_id LIMIT 500"""))
def seeded_sample(spark, sf):
    """A sample of 500 rows is the operator's result."""
    return os_.hash_sample(I.focal(spark, sf), "reviewer_id", 500).select("reviewer_id", "review_id")


@query("largest_cities_o1", using("focal", body="""
    SELECT review_id, city_id::BIGINT AS city_id FROM focal WHERE city_id IN (
        SELECT city_id FROM focal GROUP BY city_id ORDER BY count(*) DESC, city_id LIMIT 8)"""))
def largest_cities(spark, sf):
    """The eight largest groups are the operator's result."""
    return os_.top_groups(I.focal(spark, sf), "city_id", 8).select("review_id", "city_id")


@query("city_shards_union_u1", using("reviews", body="""
    SELECT city_id::BIGINT AS city_id, count(*) AS n, sum(review_id)::BIGINT AS ids FROM reviews GROUP BY city_id"""))
def city_shards_union(spark, sf):
    r = I.reviews(spark, sf)
    both = r.filter(F.col("city_id") < 12).unionByName(r.filter(F.col("city_id") >= 12))
    return both.groupBy("city_id").agg(F.count(F.lit(1)).alias("n"), F.sum("review_id").alias("ids"))


@query("years_left_out_x12", using("focal", body="SELECT review_id, year FROM focal WHERE year NOT IN (1996, 1997)"))
def years_left_out(spark, sf):
    return I.focal(spark, sf).filter(~F.col("year").isin(1996, 1997)).select("review_id", "year")


@query("shuffled_folds_c1", using("focal", body="""
    SELECT reviewer_id, (((reviewer_id + 20260901) * 2654435761) % 4294967296) % 5 AS fold FROM focal"""))
def shuffled_folds(spark, sf):
    from tidemark.operators.causal import with_folds
    return with_folds(I.focal(spark, sf), "reviewer_id").select("reviewer_id", "fold")
