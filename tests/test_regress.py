import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import absorbed, regress as rg
from tidemark.operators.features import design_matrix, zscore
from tidemark.plans import study


def data(spark, seed=0, n=60, cities=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    city = rng.integers(0, cities, n)
    lin = 0.4 + x @ [0.8, -0.5, 0.2] + 0.3 * city / cities
    y, b = lin + rng.normal(size=n), (rng.random(n) < 1 / (1 + np.exp(-lin))).astype(float)
    df = spark.createDataFrame([(int(c), *map(float, r), float(a), float(k)) for c, r, a, k in zip(city, x, y, b)],
                               "city int, x1 double, x2 double, x3 double, y double, b double")
    return df, np.column_stack([np.ones(n), x]), y, b, city


def sandwich(X, u, bread, city):
    n, k = X.shape
    scores = np.array([(X[city == g] * u[city == g][:, None]).sum(axis=0) for g in np.unique(city)])
    g = len(scores)
    inv = np.linalg.inv(bread)
    return inv @ (scores.T @ scores) @ inv * g / (g - 1) * (n - 1) / (n - k)


def test_ols_with_clustered_errors(spark):
    df, X, y, _, city = data(spark)
    fit = rg.ols(df, "y", ["x1", "x2", "x3"], "city")
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert fit.beta == pytest.approx(beta, abs=1e-8)
    assert fit.cov == pytest.approx(sandwich(X, y - X @ beta, X.T @ X, city), abs=1e-8)
    assert fit.stats["r2"] == pytest.approx(1 - ((y - X @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    plain = rg.ols(df, "y", ["x1", "x2", "x3"], "city", small_sample=False)
    assert plain.cov == pytest.approx(fit.cov * 4 / 5 * 56 / 59)


def test_logit_reaches_the_maximum(spark):
    df, X, _, b, city = data(spark, 3, 200)
    fit = rg.logit(df.repartition(5), "b", ["x1", "x2", "x3"], "city")
    p = 1 / (1 + np.exp(-X @ fit.beta))
    assert np.abs(X.T @ (b - p)).max() < 1e-5
    hess = (X * (p * (1 - p))[:, None]).T @ X
    assert fit.cov == pytest.approx(sandwich(X, b - p, hess, city), rel=1e-6)
    ll = (b * np.log(p) + (1 - b) * np.log(1 - p)).sum()
    assert fit.stats["ll"] == pytest.approx(ll) and fit.stats["aic"] == pytest.approx(-2 * ll + 8)


def test_redundant_column_does_not_stop_the_fit(spark):
    df, X, y, _, _ = data(spark)
    fit = rg.ols(df.withColumn("x4", F.col("x1") + F.col("x2")), "y", ["x1", "x2", "x3", "x4"], "city")
    fitted = np.column_stack([X, X[:, 1] + X[:, 2]]) @ fit.beta
    assert fitted == pytest.approx(X @ np.linalg.lstsq(X, y, rcond=None)[0], abs=1e-6)


def test_separated_outcome_is_refused(spark):
    df, *_ = data(spark)
    with pytest.raises(rg.NotConverged):
        rg.logit(df.withColumn("b", (F.col("x1") > 0).cast("double")), "b", ["x1", "x2"], "city")


def test_one_empty_dummy_is_refused(spark):
    df, *_ = data(spark, 3, n=600)
    empty = df.withColumn("d", (F.pmod(F.xxhash64("x1"), F.lit(10)) == 0).cast("double")).withColumn(
        "b", F.when(F.col("d") == 1, 0.0).otherwise(F.col("b")))
    with pytest.raises(rg.NotConverged):
        rg.logit(empty, "b", ["x1", "x2", "d"], "city")


def test_groups_without_variation_are_left_out(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "city int, b int")
    assert {r["city"] for r in rg.vary_within(df, "city", "b").collect()} == {0}
    assert {r["city"] for r in rg.at_least_positives(df, "city", "b", 2).collect()} == {1}


def test_group_intercepts_equal_dummies(spark):
    df, X, y, _, city = data(spark, 5)
    D = np.column_stack([X[:, 1:], *[(city == g).astype(float) for g in np.unique(city)]])
    want = np.linalg.lstsq(D, y, rcond=None)[0][:3]
    assert rg.within_group_ols(df, "y", ["x1", "x2", "x3"], "city") == pytest.approx(want, abs=1e-8)


def analysis(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hits = [int(v) for v in rng.poisson([1.2, .5, .8, .6, .9])]
        tokens = int(rng.integers(15, 300))
        p = 1 / (1 + np.exp(-(-.5 + .4 * hits[4] + .2 * hits[0])))
        rows.append((i, int(rng.integers(0, 8)), int(rng.integers(2015, 2019)), int(rng.integers(1, 13)), *hits,
                     *[100.0 * h / tokens for h in hits], *[int(h > 0) for h in hits], float(rng.normal()),
                     float(rng.random()), float(rng.random()), tokens, int(rng.integers(0, 50)), int(rng.integers(0, 900)),
                     int(rng.random() < .3), int(rng.poisson(1)), int(rng.random() < p), int(rng.random() < .3)))
    names = ["ATT", "SN", "PBC", "SAT", "BI"]
    schema = ", ".join(["reviewer_id long, city_id int, year int, month int", *[f"hits_{c} int" for c in names],
                        *[f"dens_{c} double" for c in names], *[f"pres_{c} int" for c in names],
                        "vader_compound double, vader_pos double, vader_neg double, n_tokens int, listing_prior_reviews int, "
                        "listing_age_days int, covid int, n_exclaim int, y_continue int, y_revisit int"])
    return spark.createDataFrame(rows, schema).withColumn("city", F.concat(F.lit("c"), "city_id")).persist()


def test_design_matrix_columns_are_scaled(spark):
    rows, names = design_matrix(analysis(spark), "dens")
    pdf = rows.toPandas()
    for c in ["ATT", "BI", "SENT", "log_len", "cm_ATT", "cm_BI"]:
        assert pdf[c].mean() == pytest.approx(0, abs=1e-9) and pdf[c].std(ddof=0) == pytest.approx(1)
    assert [n for n in names if n.startswith("yr_")] == ["yr_2016", "yr_2017", "yr_2018"]
    raw = analysis(spark).toPandas()      # in every mode the city means are means of hits
    cm = raw.groupby("city_id")["hits_ATT"].transform("mean")
    assert sorted(pdf["cm_ATT"].round(9)) == sorted(((cm - cm.mean()) / cm.std(ddof=0)).round(9))


def test_pair_fit_and_its_tables(spark):
    df = analysis(spark)
    pair = rg.fit_pair(df, "y_continue")
    assert pair.behaviour.row("BI")[0] > 0 and "BI" not in pair.intention.names
    table = {r["variable"]: (r["eq1_BI"], r["eq2_behaviour"]) for r in rg.pair_table(spark, pair).collect()}
    assert list(table)[0] == "Revisit intention (BI)" and table["Revisit intention (BI)"][0] == ""
    med = rg.mediation(spark, pair).collect()
    for r in med:
        assert r["ci_lo"] < r["indirect"] < r["ci_hi"]
        a, sa, _ = pair.intention.row({v: k for k, v in rg.LABELS.items()}[r["antecedent"]])
        b, sb, _ = pair.behaviour.row("BI")
        spread = (a * a * sb * sb + b * b * sa * sa + sa * sa * sb * sb) ** .5
        assert (r["ci_hi"] - r["ci_lo"]) == pytest.approx(3.92 * spread, rel=.15)
    fixed = rg.fit_pair(df, "y_continue", city_levels=True)
    assert "city_1" in fixed.behaviour.names and not any(n.startswith("cm_") for n in fixed.behaviour.names)


def test_strata_fits_cover_all_rows(spark):
    df = analysis(spark).withColumn("stratum", rg.length_stratum(F.col("n_tokens")))
    fits = rg.strata_fits(df, "stratum", "hits_BI", ["hits_ATT", "hits_SAT"], "city_id")
    assert [s for s, _ in fits] == ["15-40", "40-70", "70-120", "120+", "ALL"]
    assert sum(f.n for s, f in fits if s != "ALL") == fits[-1][1].n == 400
    cells = rg.strata_table(spark, fits, ["hits_ATT", "hits_SAT"]).collect()
    assert all(re.fullmatch(r"[+-]\d\.\d{4}\*{0,3}", r["hits_ATT"]) for r in cells)


def test_one_specification_is_replaced(spark):
    df = analysis(spark)
    runs = study.robustness_samples(df, ["y_continue"], years=(2016,), largest=3, fixed_effects_rows=300)
    table = study.summary(spark, runs)
    assert [r["N"] for r in table.collect()][2] == 300 and table.filter("spec like 'R2%'").first()["cities"] == 3
    again = study.rerun_spec(spark, table, "R3 destination FE", [("R3 destination FE", runs[0][1], 1.0)])
    assert again.count() == 3 and again.filter("spec like 'R3%'").first()["N"] == runs[0][1].behaviour.n


def test_constant_column_has_no_z_score(spark):
    assert zscore(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"]).first()["x_z"] is None


def test_a_dummy_that_fixes_the_outcome_is_named(spark):
    df, *_ = data(spark, 3, n=600)
    hashed = F.pmod(F.xxhash64("x1"), F.lit(10))
    rows = df.withColumn("d", (hashed == 0).cast("double")).withColumn("e", (hashed != 1).cast("double")).withColumn(
        "b", F.when(F.col("d") == 1, 0.0).when(F.col("e") == 0, 1.0).otherwise(F.col("b"))).withColumn(
        "flat", F.lit(2.5)).withColumn("empty", F.lit(None).cast("double")).persist()
    fit = rg.logit(rows, "b", ["x1", "d", "x2", "e", "flat", "empty"], "city", leave_out=True)
    ones, zeros = rows.filter("d = 1").count(), rows.filter("e = 0").count()
    assert sorted(fit.left_out) == [("d", "1 fixes the outcome", ones), ("e", "0 fixes the outcome", zeros), ("empty", "constant", 0), ("flat", "constant", 0)]
    plain = rg.logit(rows.filter("d = 0 and e = 1"), "b", ["x1", "x2"], "city")
    assert fit.names == ["const", "x1", "x2"] and fit.n == plain.n == 600 - ones - zeros
    assert fit.beta == pytest.approx(plain.beta, abs=1e-8) and fit.cov == pytest.approx(plain.cov, rel=1e-6)
    with pytest.raises(ValueError, match="x1 is null in"):
        rg.logit(rows.withColumn("x1", F.when(F.col("x1") > 0, F.col("x1"))), "b", ["x1"], "city", leave_out=True)


def two_together(spark, n, mixed):
    """a = b = 1 is always positive, a = b = 0 never; `mixed` rows where one of them is 1 are both."""
    rows = [(i % 7, float(k), float(k), float(i % 3), float(k)) for i in range(n) for k in (0, 1)]
    rows += [(i % 7, float(i % 2), float(1 - i % 2), float(i % 3), float(i // 2 % 2)) for i in range(mixed)]
    return spark.createDataFrame(rows, "city int, a double, b double, z double, y double")


@pytest.mark.parametrize("n, mixed", [(60, 400), (4, 20_000)])
def test_separation_by_two_regressors_is_refused(spark, n, mixed):
    df = two_together(spark, n, mixed)
    for leave_out in (False, True):
        with pytest.raises(rg.NotConverged, match="separated along .*[ab]"):
            rg.logit(df, "y", ["a", "b", "z"], "city", leave_out=leave_out)
    with pytest.raises(rg.NotConverged, match="separated along"):
        absorbed.logit_absorbed(df, "y", ["a", "b", "z"], "city")


def test_few_rows_are_put_together(spark, monkeypatch):
    df = spark.range(1000).repartition(50)
    few = rg.compact(df)
    assert few.rdd.getNumPartitions() == 4 and few.agg(F.sum("id"), F.count("id")).first()[:] == (499500, 1000)
    assert rg.compact(few) is few
    monkeypatch.setattr(rg, "TASK_ROWS", 100)
    assert rg.compact(df).rdd.getNumPartitions() == 10                  # as many as the rows ask for


def test_separated_outcome_in_the_limit(spark):
    df = two_together(spark, 60, 400)
    fit = rg.logit(df, "y", ["a", "b", "z"], "city", limit=True)
    want = rg.logit(df.filter("a <> b"), "y", ["a", "z"], "city")        # rows that the direction says nothing about
    assert fit.n == 520 and fit.stats["ll"] == pytest.approx(want.stats["ll"], abs=1e-4)
    assert fit.stats["gradient"] <= 1e-9 * fit.n
    assert np.isnan(fit.beta[:3]).all() and fit.row("z")[0] == pytest.approx(want.row("z")[0], abs=1e-6)
    assert np.isfinite(fit.row("z")[1]) and [why for _, why, _ in fit.left_out] == ["separated, no finite coefficient"]
    with pytest.raises(rg.NotConverged, match="separated along"):
        rg.logit(df.filter("a = b"), "y", ["a", "z"], "city", limit=True)              # no direction is left
    names = ["const", "BI", "ATT", "SN", "PBC", "SAT"]
    both = rg.Fit(names, np.array([1.0, np.nan, 2.0, 1.0, 1.0, 1.0]), np.eye(6), 9, 3,
                  {"mean": 0.5, "r2": 0.1, "pseudo_r2": 0.1, "aic": 1.0, "bic": 1.0})
    row = rg.run_summary(spark, [("R2", rg.PairFit("y", both, both), 0.0)]).first()
    assert row["BI->Y"] is None and row["ATT->Y"].startswith("2.0000")


def test_a_rare_outcome_is_no_separation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60_000)
    y = (rng.random(60_000) < 1 / (1 + np.exp(7.5 - x))).astype(float)
    df = spark.createDataFrame([(i % 40, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "city int, x double, y double")
    fit = rg.logit(df, "y", ["x"], "city")
    p = 1 / (1 + np.exp(-fit.beta[0] - fit.beta[1] * x))
    assert abs((y - p).sum()) < 1e-5 and abs((x * (y - p)).sum()) < 1e-5 and y.mean() < 0.002


def test_weakest_direction():
    rng = np.random.default_rng(0)
    z = np.column_stack([np.ones(200), rng.normal(size=(200, 2)) * [1, 1000]])
    z = np.column_stack([z, z[:, 1] * 2])                            # a redundant column is no direction of its own
    w = np.where(z[:, 1] > 0, 1e-9, 0.2)
    level, d = rg.weakest_direction((z * w[:, None]).T @ z, z.T @ z)
    along = z @ d
    assert level == pytest.approx((w * along ** 2).sum() / (along ** 2).sum()) and level < 0.2
    assert rg.weakest_direction(np.zeros((0, 0)), np.zeros((0, 0)))[0] == 0


def test_blocks_of_many_partitions(spark):
    df, X, *_ = data(spark, n=300)
    many = df.repartition(70).persist()
    assert rg.gram(many, ["x1", "x2"]) == pytest.approx(X[:, 1:3].T @ X[:, 1:3])
    both = [rg._sum_cells(many, ["x1"], lambda m: np.array([m.sum(), len(m)]), 2, parts) for parts in (3, 70)]
    assert both[0] == pytest.approx(both[1]) and both[0][1] == 300
    assert rg._sum_cells(many.filter("x1 > 99"), ["x1"], lambda m: np.array([m.sum(), len(m)]), 2).tolist() == [0, 0]


def with_dummies(df, cities):
    return df.select("*", *[(F.col("city") == c).cast("double").alias(f"c{c}") for c in cities])


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_eliminated_effects_equal_dummies(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(absorbed, "BROADCAST_ROWS", broadcast_rows)
    df, *_ = data(spark, 6, 900, 12)
    df = df.withColumn("city", F.when(F.rand(3) < 0.4, 3).otherwise(F.col("city"))).persist()          # one city holds a third of the rows
    x, dummies = ["x1", "x2", "x3"], [f"c{c}" for c in range(1, 12)]
    full = with_dummies(df, range(1, 12))
    for absorbing, plain, y in ((absorbed.logit_absorbed, rg.logit, "b"), (absorbed.ols_absorbed, rg.ols, "y")):
        got, want = absorbing(df, y, x, "city"), plain(full, y, [*x, *dummies], "city")
        assert got.names == x and got.n == want.n and got.groups == want.groups == 12
        assert got.beta == pytest.approx(want.beta[1:4], abs=1e-7)
        assert got.cov == pytest.approx(want.cov[1:4, 1:4], rel=1e-6, abs=1e-12)
        for stat in set(want.stats) - {"gradient"}:
            assert got.stats[stat] == pytest.approx(want.stats[stat], rel=1e-8), stat


def test_groups_and_dummies_that_fix_the_outcome_go_in_turn(spark):
    rng = np.random.default_rng(8)
    rows = [(c, float(rng.normal()), 0.0, float(rng.random() < 0.5)) for c in range(6) for _ in range(60)]
    rows += [(6, float(rng.normal()), 0.0, 1.0) for _ in range(10)]                                     # never varies
    # City 7 varies only through rows of a dummy that fixes the outcome, so it goes after the dummy.
    rows += [(7, float(rng.normal()), 1.0, 1.0) for _ in range(5)] + [(7, float(rng.normal()), 0.0, 0.0) for _ in range(8)]
    rows += [(None, 1.0, 0.0, 1.0), (None, 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "city int, x double, d double, y double")
    fit = absorbed.logit_absorbed(df, "y", ["x", "d"], "city")
    assert fit.names == ["x"] and fit.n == 360 and fit.groups == 6
    assert fit.left_out == [("d", "1 fixes the outcome", 5), ("2 groups", "the outcome does not vary", 18)]
    want = rg.logit(with_dummies(df.filter("city < 6"), range(1, 6)), "y", ["x", *[f"c{c}" for c in range(1, 6)]], "city")
    assert fit.beta[0] == pytest.approx(want.beta[1], abs=1e-7)
    with pytest.raises(rg.NotConverged):
        absorbed.logit_absorbed(df.filter("city >= 6"), "y", ["x", "d"], "city")


def test_more_groups_than_dummies_could_hold(spark):
    """6,000 cities: no list of levels, slopes near the truth."""
    rows = spark.range(60_000).select((F.col("id") % 6_000).cast("int").alias("city"), F.randn(1).alias("x"), F.rand(2).alias("u")).select(
        "city", "x", (F.col("u") < 1 / (1 + F.exp(-(0.7 * F.col("x") + F.col("city") % 5 - 2)))).cast("double").alias("y"))
    fit = absorbed.logit_absorbed(rows, "y", ["x"], "city")
    assert fit.groups + sum(int(w.split()[0]) for w, *_ in fit.left_out) == 6_000 and abs(fit.stats["gradient"]) < 1e-3
    assert 0.65 < fit.beta[0] < 0.9                      # ten rows a city: the known upward bias of effects estimated along


def test_lost_cities_and_rows_are_reported(spark):
    df = analysis(spark).withColumn("y_continue", F.when(F.col("city_id") == 2, 1).when(F.col("year") == 2017, 0).otherwise(F.col("y_continue")))
    pair = rg.fit_pair(df, "y_continue", city_effects=True)
    rows = df.filter("city_id = 2").count(), df.filter("city_id <> 2 and year = 2017").count()
    assert pair.left_out == [("1 cities", "the outcome does not vary", rows[0]), ("yr_2017", "1 fixes the outcome", rows[1])]
    assert pair.behaviour.n == 400 - sum(rows) and pair.behaviour.groups == 7 and "yr_2017" in pair.intention.names
    table = rg.left_out_table(spark, [("R3", pair, 1.0)]).collect()
    assert [tuple(r) for r in table] == [("R3", "y_continue", *lost) for lost in pair.left_out]
    dummies = rg.fit_pair(df, "y_continue", city_levels=True)
    assert pair.behaviour.row("BI") == pytest.approx(dummies.behaviour.row("BI"), rel=1e-6)
    assert pair.intention.row("ATT") == pytest.approx(dummies.intention.row("ATT"), rel=1e-6)
