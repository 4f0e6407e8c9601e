import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from tidemark.functions.scalar import hash32, in_hash_sample
from tidemark.operators import cohort as co

SCHEMA = "reviewer_id long, review_id long, listing_id long, city_id int, date_i int"
RULE = co.CohortRule(per_1000=1000, start_day=100, censor_day=2000)


def expected(rows, rule=RULE):
    """Plain Python statement of the cohort."""
    context, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[4], r[1])):
        context.setdefault((r[3], r[2]), []).append(r)
    for reviewer in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == reviewer), key=lambda r: (r[4], r[1], r[3], r[2]))
        f = mine[0]
        if not (rule.start_day is None or f[4] >= rule.start_day) or f[4] > rule.censor_day - rule.window_days:
            continue
        later = [r for r in mine if rule.lag_days <= r[4] - f[4] <= rule.window_days]
        group = context[f[3], f[2]]
        out[reviewer] = (f[1], group.index(f), f[4] - group[0][4], len(later), sum(r[2] == f[2] for r in later),
                         min((r[4] - f[4] for r in later), default=None))
    return out


def actual(df):
    return {r["reviewer_id"]: (r["review_id"], r["listing_prior_reviews"], r["listing_age_days"], r["n_future"],
                               r["n_future_same"], r["days_to_next"]) for r in df.collect()}


EDGES = [
    (1, 10, 5, 0, 100), (1, 11, 5, 0, 100), (1, 12, 5, 0, 189), (1, 13, 5, 0, 190), (1, 14, 6, 0, 830), (1, 15, 6, 0, 831),
    (2, 20, 5, 0, 99),                                    # one day before the start
    (3, 30, 7, 1, 1270),                                  # the last eligible day
    (4, 40, 7, 1, 1271),                                  # one day too late
    (5, 50, 8, 1, 500), (5, 50, 8, 2, 500), (5, 51, 8, 2, 700),   # one review in two cities
    (6, 60, 9, 1, 400), (6, 60, 9, 1, 400), (6, 61, 9, 1, 600), (6, 61, 9, 1, 600),   # copies count twice
]


def test_window_is_closed_and_ties_are_ordered(spark):
    found = actual(co.focal_panel(spark.createDataFrame(EDGES, SCHEMA), RULE))
    assert found == expected(EDGES)
    assert found[1][3:] == (2, 1, 90)
    assert set(found) == {1, 3, 5, 6}
    assert found[6][3] == 2


def test_open_lag_leaves_out_the_first_day(spark):
    found = actual(co.focal_panel(spark.createDataFrame(EDGES, SCHEMA), replace(RULE, lag_inclusive=False)))
    assert found[1][3:] == (1, 0, 730)


def random_rows(seed, n=600):
    rng = random.Random(seed)
    # A third of the rows belongs to one reviewer, another third to one listing.
    rows = []
    for i in range(n):
        rows.append((1 if i % 3 == 0 else rng.randrange(2, 60), 1000 + rng.randrange(n), 5 if i % 3 == 1 else rng.randrange(6, 20),
                     rng.randrange(3) if i % 3 != 1 else 0, rng.randrange(100, 1900)))
    return rows + rows[:20]


@pytest.mark.parametrize("hot_rows", [1, 150, 10 ** 9])
def test_hot_keys_take_another_way_to_the_same_result(spark, hot_rows):
    rows = random_rows(7)
    df = spark.createDataFrame(rows, SCHEMA)
    assert actual(co.focal_panel(df, RULE, hot_rows)) == expected(rows)


def test_result_ignores_partitioning_and_date_shift(spark):
    rows = random_rows(11, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    base = actual(co.focal_panel(df, RULE))
    assert actual(co.focal_panel(df.repartition(7, "date_i"), RULE)) == base
    shifted = df.withColumn("date_i", F.col("date_i") + 50)
    assert actual(co.focal_panel(shifted, replace(RULE, start_day=150, censor_day=2050))) == base


def test_wider_window_never_loses_an_outcome(spark):
    df = spark.createDataFrame(random_rows(3, 200), SCHEMA)
    narrow = {r: v[3] for r, v in actual(co.focal_panel(df, replace(RULE, censor_day=3000, window_days=300))).items()}
    wide = {r: v[3] for r, v in actual(co.focal_panel(df, replace(RULE, censor_day=3000, window_days=600))).items()}
    assert all(wide[r] >= n for r, n in narrow.items())


def test_hash_equals_wrapping_multiplication(spark):
    ids = [0, 1, 2 ** 32 - 1, 2 ** 32, 2 ** 53 + 1, 2 ** 62]
    found = {r["id"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "id long").withColumn("h", hash32(F.col("id"))).collect()}
    assert found == {i: (i * 2654435761) % 2 ** 64 % 2 ** 32 for i in ids}


def test_sample_is_a_union_of_residues(spark):
    ids = spark.range(20000)
    assert ids.filter(in_hash_sample(F.col("id"), 1000)).count() == 20000
    small = {r["id"] for r in ids.filter(in_hash_sample(F.col("id"), 20)).collect()}
    large = {r["id"] for r in ids.filter(in_hash_sample(F.col("id"), 50)).collect()}
    assert small < large


def test_listing_context_is_taken_before_the_sample(spark):
    df = spark.createDataFrame(random_rows(5, 300), SCHEMA)
    whole = {r["reviewer_id"]: r["listing_prior_reviews"] for r in co.focal_panel(df, RULE).collect()}
    part = co.focal_panel(df, replace(RULE, per_1000=400)).collect()
    assert part and all(whole[r["reviewer_id"]] == r["listing_prior_reviews"] for r in part)


def test_one_shuffle_on_the_reviewer(spark):
    df = spark.createDataFrame(random_rows(5, 300), SCHEMA)
    plan = co.with_outcomes(df, RULE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(reviewer_id") == 1


def test_pairs_add_up_to_the_counts(spark):
    df = spark.createDataFrame(random_rows(13, 300), SCHEMA)
    firsts = co.first_reviews(df).filter(co.is_eligible(F.col("date_i"), RULE))
    counts = {r["reviewer_id"]: (r["n_future"], r["n_future_same"]) for r in co.with_outcomes(df, RULE).collect() if r["n_future"]}
    pairs = co.window_pairs(firsts, df, RULE).groupBy("reviewer_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("listing_id") == F.col("l0")).alias("s"))
    assert {r["reviewer_id"]: (r["n"], r["s"]) for r in pairs.collect()} == counts
    mine = co.reviews_of(df, firsts)
    assert mine.count() == df.join(firsts.select("reviewer_id"), "reviewer_id").count()


def test_panel_of_the_view_reads_its_rows_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.createDataFrame([(i, i % 7, i % 3, 1, 9000 + i) for i in range(50)],
                                 "review_id long, reviewer_id long, listing_id long, city_id int, date_i int")
    monkeypatch.setattr(inputs, "reviews", lambda spark, sf: rows.mapInArrow(counted, rows.schema))
    found = {tuple(r) for r in inputs.focal(spark, "").collect()}
    assert seen.value == 50                                     # counts of hot keys and both windows read a written table
    assert found == {tuple(r) for r in co.focal_panel(rows, inputs.VIEW_RULE).collect()} and found
