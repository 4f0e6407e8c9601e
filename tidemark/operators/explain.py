"""Attribution, accumulated local effects, spline shapes and counterfactual effort.

A model is given as `scorer`: DataFrame -> DataFrame with an added `score`. What-if
copies of the rows are built first and scored in one pass.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import spline
from tidemark.functions.scalar import SEED
from tidemark.operators.features import CONSTRUCTS, SENTIMENT
from tidemark.operators.learners import probability
from tidemark.operators.order_stats import bin_index, hash_sample, quantile_values, running_centred

Scorer = Callable[[DataFrame], DataFrame]
ALE_FEATURES = CONSTRUCTS + ["SENT", "log_len", "log_prior"]
MIN_BIN_ROWS = 30
STEPS = 20


def model_scorer(model: PipelineModel, margin: bool = False) -> Scorer:
    return lambda df: model.transform(df).withColumn("score", probability(margin)).drop(
        "_x", "rawPrediction", "probability", "prediction")


def linear_scorer(weights: Mapping[str, float], intercept: float = 0.0) -> Scorer:
    total = F.lit(intercept)
    for name, w in weights.items():
        total = total + F.col(name) * F.lit(w)
    return lambda df: df.withColumn("score", total)


def linear_attribution(df: DataFrame, weights: Mapping[str, float], key: str) -> DataFrame:
    """(key, feature, phi) of a linear score: weight times the distance from the mean, exact."""
    names = list(weights)
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    parts = [F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.lit(means[c])) * F.lit(weights[c])).alias("phi"))
             for c in names]
    return df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.feature", "p.phi")


def sampled_attribution(df: DataFrame, scorer: Scorer, features: Sequence[str], key: str,
                        permutations: int = 8, seed: int = SEED) -> DataFrame:
    """(key, feature, phi) of any model against the mean row, averaged over random feature orders.

    Along one order the features switch from their mean to the row's own value one by
    one; each change in score is credited to the feature switched. The credits of a row
    sum exactly to its score minus the score of the mean row.
    """
    names = list(features)
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    rng = random.Random(seed)
    orders = [rng.sample(names, len(names)) for _ in range(permutations)]
    # Position of each feature in each order; a feature is switched on when step > position.
    order_rows = [F.struct(F.array(*[F.lit(o) for o in order]).alias("order"),
                           *[F.lit(order.index(c)).alias(f"at_{i}") for i, c in enumerate(names)])
                  for order in orders]
    long = (df.select(key, *names).withColumn("_o", F.explode(F.array(*order_rows)))
            .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(names))))))
    mixed = long.select(key, "_o.order", "_step", *[
        F.when(F.col("_step") > F.col(f"_o.at_{i}"), F.col(c)).otherwise(F.lit(means[c])).alias(c)
        for i, c in enumerate(names)])
    scored = scorer(mixed)
    weight = F.col("score") / F.lit(permutations)
    gained = F.when(F.col("_step") > 0, F.struct(F.element_at("order", F.col("_step")).alias("feature"),
                                                 weight.alias("phi")))
    lost = F.when(F.col("_step") < len(names), F.struct(F.element_at("order", F.col("_step") + 1).alias("feature"),
                                                        (-weight).alias("phi")))
    credits = scored.select(key, F.explode(F.array_compact(F.array(gained, lost))).alias("c"))
    return credits.groupBy(key, "c.feature").agg(F.sum("c.phi").alias("phi"))


def block_of(feature: Column) -> Column:
    return (F.when(feature.isin(CONSTRUCTS), "TPB construct")
            .when(feature.isin(SENTIMENT), "sentiment").otherwise("control"))


def importance(attribution: DataFrame) -> DataFrame:
    """Mean |phi|, mean phi, share of the total and block per feature, largest first."""
    per = attribution.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"),
                                             F.avg("phi").alias("mean_shap"))
    total = per.agg(F.sum("mean_abs_shap").alias("_t"))
    return per.join(F.broadcast(total)).select(   # one row of totals
        "feature", "mean_abs_shap", "mean_shap",
        (100 * F.col("mean_abs_shap") / F.col("_t")).alias("share_pct"),
        block_of(F.col("feature")).alias("block")).orderBy(F.desc("mean_abs_shap"), "feature")


def block_share(table: DataFrame, block: str = "TPB construct", top: int | None = None) -> DataFrame:
    """Share of one block among all features, or among the `top` most important."""
    shown = table if top is None else table.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)
    return shown.agg(F.sum(F.when(F.col("block") == block, F.col("share_pct")).otherwise(0.0)).alias("share_pct"))


def local_effects(df: DataFrame, scorer: Scorer, features: Sequence[str], bins: int = 20,
                  least: int = MIN_BIN_ROWS) -> DataFrame:
    """(feature, x, ale): accumulated local effects over quantile bins.

    Every row is scored at both edges of its own bin. A bin under `least` rows has no
    effect; a feature with fewer than three edges is left out.
    """
    spark = df.sparkSession
    probs = [k / bins for k in range(bins + 1)]
    edges = {c: sorted(set(v)) for c, v in quantile_values(df, features, probs).items()}
    edges = {c: e for c, e in edges.items() if len(e) >= 3}
    if not edges:
        return spark.createDataFrame([], "feature string, x double, ale double")
    picks = []
    for c, e in edges.items():
        k = bin_index(F.col(c), e)
        cuts = F.array(*[F.lit(float(v)) for v in e])
        for sign, shift in ((-1.0, 1), (1.0, 2)):
            picks.append(F.struct(F.lit(c).alias("feature"), k.alias("k"), F.lit(sign).alias("sign"),
                                  F.element_at(cuts, k + shift).alias("at")))
    others = [c for c in df.columns if c not in edges]
    long = df.withColumn("_e", F.explode(F.array(*picks)))
    moved = long.select(*others, "_e", *[
        F.when(F.col("_e.feature") == c, F.col("_e.at")).otherwise(F.col(c)).alias(c) for c in edges])
    effects = (scorer(moved).groupBy(F.col("_e.feature").alias("feature"), F.col("_e.k").alias("k"))
               .agg(F.sum(F.col("score") * F.col("_e.sign")).alias("s"), F.count_if(F.col("_e.sign") > 0).alias("n"))
               .select("feature", (F.col("k") + 1).alias("edge"),
                       F.when(F.col("n") >= least, F.col("s") / F.col("n")).otherwise(0.0).alias("effect")))
    grid = spark.createDataFrame([(c, i, float(v)) for c, e in edges.items() for i, v in enumerate(e)],
                                 "feature string, edge int, x double")
    steps = grid.join(effects, ["feature", "edge"], "left").withColumn("effect", F.coalesce("effect", F.lit(0.0)))
    return running_centred(steps, ["feature"], "edge", "effect", "ale").select("feature", "x", "ale")


class SplineShapes:
    """Additive logistic model on spline bases of every feature."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str = "y", c: float = 0.5) -> None:
        self.features = list(features)
        limits = train.agg(*[f(x).alias(f"{x}__{k}") for x in self.features
                             for k, f in (("lo", F.min), ("hi", F.max))]).first()
        self.range = {x: (float(limits[f"{x}__lo"]), float(limits[f"{x}__hi"])) for x in self.features}
        rows = self.expand(train).withColumn("_label", F.col(label).cast("double")).select("_b", "_label").persist()
        n = rows.count()
        self.model = LogisticRegression(featuresCol="_b", labelCol="_label", regParam=1.0 / (c * n),
                                        elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-6).fit(rows)
        rows.unpersist()
        found = [float(v) for v in self.model.coefficients]
        self.weights = {x: found[i * spline.BASIS:(i + 1) * spline.BASIS] for i, x in enumerate(self.features)}
        self.train = train

    def expand(self, df: DataFrame) -> DataFrame:
        """Add the vector of all basis values."""
        values = F.concat(*[spline.basis(F.col(x), *self.range[x]) for x in self.features])
        return df.withColumn("_b", array_to_vector(values))

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.expand(df)).withColumn("score", probability(False)).drop(
            "_b", "rawPrediction", "probability", "prediction")

    def shapes(self, features: Sequence[str], points: int = 40) -> DataFrame:
        """(feature, x, f): contribution at quantile points from .01 to .99, centred."""
        probs = [.01 + k * .98 / (points - 1) for k in range(points)]
        grid = quantile_values(self.train, features, probs)
        spark = self.train.sparkSession
        rows = [(c, i, float(v)) for c in features for i, v in enumerate(grid[c])]
        f = F.lit(None).cast("double")
        for c in features:
            weights = F.array(*[F.lit(w) for w in self.weights[c]])
            terms = F.zip_with(spline.basis(F.col("x"), *self.range[c]), weights, lambda b, w: b * w)
            value = F.aggregate(terms, F.lit(0.0), lambda total, v: total + v)
            f = F.when(F.col("feature") == c, value).otherwise(f)
        raw = spark.createDataFrame(rows, "feature string, ord int, x double").withColumn("f", f)
        mean = raw.groupBy("feature").agg(F.avg("f").alias("_m"))
        return raw.join(F.broadcast(mean), "feature").select("feature", "ord", "x", (F.col("f") - F.col("_m")).alias("f"))


def counterfactual_effort(df: DataFrame, scorer: Scorer, features: Sequence[str], key: str,
                          rows: int | None = None, top: float = 0.90, toward: float = 0.99,
                          steps: int = STEPS) -> DataFrame:
    """Share of rows below the `top` score quantile that a rise in one feature lifts over it, and the median effort.

    Effort is the fraction of the way to the feature's `toward` quantile; a value is
    never lowered. All features and steps are scored in one pass. `rows` samples the
    rows below the threshold; None uses all of them.
    """
    scored = scorer(df).persist()
    cut = quantile_values(scored, ["score"], [top])["score"][0]
    highs = {c: v[0] for c, v in quantile_values(df, features, [toward]).items()}
    below = scored.filter(F.col("score") < F.lit(cut)).drop("score")
    if rows is not None:
        below = hash_sample(below, key, rows)
    trials = F.array(*[F.struct(F.lit(c).alias("construct"), F.lit(h).alias("high")) for c, h in highs.items()])
    long = (below.withColumn("_t", F.explode(trials))
            .withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(steps)))))
    part = F.col("_s") / F.lit(float(steps))

    def moved(c: str) -> Column:
        target = F.col(c) + part * (F.col("_t.high") - F.col(c))
        return F.when(F.col("_t.construct") == c, F.greatest(F.col(c), target)).otherwise(F.col(c)).alias(c)

    others = [c for c in below.columns if c not in highs]
    tried = scorer(long.select(*others, "_t", "_s", *[moved(c) for c in highs]))
    effort = tried.groupBy(key, F.col("_t.construct").alias("construct")).agg(
        F.min(F.when(F.col("score") >= F.lit(cut), part)).alias("effort"))
    # At most `steps` distinct efforts, so the exact median is a small map per construct.
    return effort.groupBy("construct").agg(
        F.round(100.0 * F.count("effort") / F.count(F.lit(1)), 2).alias("share_flippable_pct"),
        F.round(F.percentile("effort", F.lit(0.5)), 3).alias("median_effort_of_max"))
