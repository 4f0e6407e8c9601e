import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import spline
from tidemark.operators import causal as ca, explain as ex, learners as le, metrics as mt
from tidemark.operators.features import CONSTRUCTS, FEATURES
from tidemark.plans import study
from tests.test_regress import analysis


def rows(spark, n=300, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double"), x


def bent(df):
    return df.withColumn("score", F.col("a") * F.col("b") + F.sin("c"))


def test_sampled_credits_add_up(spark):
    df, x = rows(spark, 60)
    phi = ex.sampled_attribution(df, bent, ["a", "b", "c"], "id", 4).groupBy("id").agg(F.sum("phi").alias("s"))
    m = x.mean(axis=0)
    base = m[0] * m[1] + np.sin(m[2])
    for r in phi.collect():
        a, b, c = x[r["id"]]
        assert r["s"] == pytest.approx(a * b + np.sin(c) - base)


def test_independent_feature_gets_its_exact_share(spark):
    df, x = rows(spark, 60)
    phi = {r["id"]: r["phi"] for r in ex.sampled_attribution(df, bent, ["a", "b", "c"], "id", 4).filter("feature = 'c'").collect()}
    assert phi == pytest.approx({i: np.sin(x[i, 2]) - np.sin(x[:, 2].mean()) for i in range(60)})


def test_local_effects_against_numpy(spark):
    df, x = rows(spark, 900)
    got = ex.local_effects(df, bent, ["a"], bins=10).collect()
    edges = np.unique(np.quantile(x[:, 0], np.linspace(0, 1, 11)))
    which = np.clip(np.searchsorted(edges, x[:, 0], side="left") - 1, 0, len(edges) - 2)
    eff = [np.mean((edges[k + 1] - edges[k]) * x[which == k, 1]) for k in range(len(edges) - 1)]
    acc = np.concatenate([[0], np.cumsum(eff)])
    found = sorted((r["x"], r["ale"]) for r in got)
    assert [v for _, v in found] == pytest.approx(list(acc - acc.mean()))


def test_local_effects_leave_out_a_nearly_constant_feature_and_small_bins(spark):
    df, _ = rows(spark, 40)
    assert ex.local_effects(df.withColumn("a", F.lit(1.0)), bent, ["a"]).count() == 0
    assert all(r["ale"] == 0 for r in ex.local_effects(df, bent, ["a"], bins=20).collect())


def test_spline_basis_against_the_recursion(spark):
    low, high, n = -1.0, 3.0, spline.KNOTS
    h = (high - low) / (n - 1)
    t = [low + (i - 3) * h for i in range(n + 6)]

    def b(i, k, v):
        if k == 0:
            return float(t[i] <= v < t[i + 1])
        return (v - t[i]) / (k * h) * b(i, k - 1, v) + (t[i + k + 1] - v) / (k * h) * b(i + 1, k - 1, v)
    points = [-1.0, -.77, 0.0, .3, 1.4, 2.2, 2.999]
    df = spark.createDataFrame([(p,) for p in points + [-5.0, 9.0, 3.0]], "x double")
    got = [r["v"] for r in df.select(spline.basis(F.col("x"), low, high).alias("v")).collect()]
    for p, v in zip(points, got):
        assert v == pytest.approx([b(i, 3, p) for i in range(spline.BASIS)], abs=1e-12)
    assert got[-3] == got[0] and got[-2] == got[-1]


def test_counterfactual_effort_against_brute_force(spark):
    df, x = rows(spark, 400)

    def scorer(d):
        return d.withColumn("score", F.col("a") + 0.5 * F.col("b"))
    s = x[:, 0] + .5 * x[:, 1]
    thr, highs = np.quantile(s, .9), {"a": (0, 1.0, np.quantile(x[:, 0], .99)), "b": (1, .5, np.quantile(x[:, 1], .99))}
    for r in ex.counterfactual_effort(df, scorer, ["a", "b"], "id").collect():
        j, w, hi = highs[r["construct"]]
        need = []
        for i in np.where(s < thr)[0]:
            steps = [k / 20 for k in range(1, 21) if s[i] + w * (max(x[i, j], x[i, j] + k / 20 * (hi - x[i, j])) - x[i, j]) >= thr]
            need.append(min(steps, default=None))
        ok = [v for v in need if v is not None]
        assert r["share_flippable_pct"] == pytest.approx(100 * len(ok) / len(need), abs=.006)
        assert r["median_effort_of_max"] == pytest.approx(np.median(ok), abs=6e-4)


def planted(spark, n=2000, theta=0.7, seed=6):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    t = .8 * z + rng.normal(size=n)
    y = theta * t + 1.5 * z + rng.normal(size=n)
    df = spark.createDataFrame([(i, i % 20, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(z, t, y))],
                               "id long, city int, z double, t double, y double")
    return ca.with_folds(df, "id").persist()


def test_planted_effect_is_recovered(spark):
    df = planted(spark)
    res = ca.residuals_linear(df, "y", "t", ["z"])
    theta, se = ca.partialled_effect(res, "city")
    assert abs(theta - .7) < 4 * se and .01 < se < .05
    pdf = res.toPandas()
    for f in range(5):
        other, own = pdf[pdf.fold != f], pdf[pdf.fold == f]
        slope, inter = np.polyfit(other.z, other.t, 1)
        assert own.t_res.to_numpy() == pytest.approx((own.t - inter - slope * own.z).to_numpy(), abs=1e-8)
    v, u = pdf.t_res, pdf.y_res - theta * pdf.t_res
    assert se == pytest.approx(np.sqrt(((v * u).groupby(pdf.city).sum() ** 2).sum()) / (v * v).sum())


def test_boosted_learners_recover_it_roughly(spark):
    df = planted(spark, 1200)
    res = ca.residuals_fitted(df, "y", "t", ["z"], folds=5, learner=lambda label: ca.boosted(label, 15, 3))
    assert res.count() == 1200
    theta, _ = ca.partialled_effect(res, "city")
    assert theta == pytest.approx(.7, abs=.2)


def test_forest_skips_rows_without_treatment_residual(spark):
    df = ca.residuals_linear(planted(spark, 400), "y", "t", ["z"]).withColumn(
        "t_res", F.when(F.col("id") < 5, 0.0).otherwise(F.col("t_res")))
    got = ca.effect_forest(df, ["z"], trees=5, min_leaf=40)
    assert got.count() == 395 and got.agg(F.avg("cate")).first()[0] == pytest.approx(.7, abs=.3)


def test_effects_of_all_constructs_in_two_passes_equal_single_fits(spark):
    df = analysis(spark)
    every = {r["construct"]: r["theta"] for r in study.estimate_effects_linear(df, "y_continue").collect()}
    used = study._effect_rows(df, "y_continue", "reviewer_id", None, None)
    theta, _ = ca.partialled_effect(ca.residuals_linear(used, "y", "SN", study._controls("SN")), "city_id")
    assert every["SN"] == pytest.approx(theta, abs=1e-6) and every["BI"] > 0


def ridge_logit_auc(pdf, cols):
    """Test AUC of the logistic with half the squared weights added to the summed loss."""
    train, test = pdf[pdf.split == "train"], pdf[pdf.split == "test"]
    X, b = np.column_stack([np.ones(len(train)), train[cols]]), np.zeros(len(cols) + 1)
    R = np.diag([0.0] + [1.0] * len(cols))
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        b += np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + R, X.T @ (train.y - p) - R @ b)
    s = test[cols].to_numpy() @ b[1:]
    pos, neg = s[test.y == 1], s[test.y == 0]
    return (pos[:, None] > neg).mean() + .5 * (pos[:, None] == neg).mean()


def test_comparison_beats_the_majority(spark, tmp_path):
    df = analysis(spark, 900)
    few = {e.model: e for e in le.candidates(histogram_rounds=3, leaf_rounds=3, epochs=15, hidden=(5,))}
    from tidemark.sources.tables import Ledger
    book = Ledger(spark, str(tmp_path / "ledger"), ["model", "config"])
    keep = [e for m, e in few.items() if m[:2] in ("B0", "B2", "M1", "M2", "M4")]
    first = study.compare_models(df, "y_continue", book, keep[:2], train_to=2015, validation_to=2016)
    assert first.count() == 2
    table = {r["model"]: r for r in study.compare_models(df, "y_continue", book, keep, train_to=2015, validation_to=2016).collect()}
    assert len(table) == 5 and table["B0 majority class"]["test_auc"] == .5
    pdf = study.model_rows(df, "y_continue", train_to=2015, validation_to=2016).toPandas()
    for model, cols in (("M1 logistic regression", FEATURES), ("B2 TPB-only", CONSTRUCTS)):
        assert table[model]["test_auc"] == pytest.approx(ridge_logit_auc(pdf, cols), abs=1e-3)
    assert table["B2 TPB-only"]["test_auc"] > .58


def test_model_survives_saving_and_explains(spark, tmp_path):
    from pyspark.ml import PipelineModel
    data = study.model_rows(analysis(spark), "y_continue", train_to=2015, validation_to=2016).persist()
    entry = next(e for e in le.candidates() if e.model.startswith("M1"))
    model = le.fit(data, entry, 100)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (le.score(data, entry, m, 0.0).agg(F.sum("score")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
    parts = study.explain_model(data, ex.model_scorer(again), sample=50, effort=40)
    assert parts["importance"].count() == len(FEATURES)
    assert parts["importance"].agg(F.sum("share_pct")).first()[0] == pytest.approx(100)
    gam = ex.SplineShapes(data.filter("split = 'train'"), FEATURES)
    assert mt.ranking_metrics(mt.score_table(gam.score(data), "score", "y")).first()["auc"] > .5
    assert gam.shapes(["BI"]).agg(F.avg("f")).first()[0] == pytest.approx(0, abs=1e-9)
