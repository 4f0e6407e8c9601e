"""Scaling, encoding and the two model matrices built from an analysis table.

Means, deviations and year levels are a handful of numbers, so they are read once and
enter the plan as literals; the rows themselves then need one narrow projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalar import log1p_floor, month_cos, month_sin
from tidemark.operators.skew import lookup_join

# Construct order and feature blocks.
ANTECEDENTS = ["ATT", "SN", "PBC", "SAT"]
CONSTRUCTS = ["ATT", "SN", "PBC", "SAT", "BI"]
SENTIMENT = ["SENT", "vader_pos", "vader_neg"]
CONTROLS = ["log_len", "n_exclaim", "log_prior", "log_age", "covid", "month_sin", "month_cos", "city_rate"]
FEATURES = CONSTRUCTS + SENTIMENT + CONTROLS
SMOOTHING = 50.0


def moments(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each expression, in one aggregate."""
    row = df.agg(*[f(e.cast("double")).alias(f"{n}__{k}") for n, e in exprs.items()
                   for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    return {n: (row[f"{n}__mean"], row[f"{n}__sd"]) for n in exprs}


def scaled(x: Column, mean: float, sd: float) -> Column:
    """(x - mean) / sd, null where the deviation is zero."""
    return F.try_divide(x.cast("double") - F.lit(mean), F.lit(sd))


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    stats = moments(df, {c: F.col(c) for c in cols})
    return df.select("*", *[scaled(F.col(c), *stats[c]).alias(c + suffix) for c in cols])


def standardise(df: DataFrame, cols: Sequence[str], fit_on: Column) -> DataFrame:
    """Scale by the mean and population deviation of the rows in `fit_on`; a constant column is divided by 1."""
    stats = moments(df.filter(fit_on), {c: F.col(c) for c in cols})
    others = [c for c in df.columns if c not in cols]
    return df.select(*others, *[scaled(F.col(c), m, s or 1.0).alias(c) for c, (m, s) in stats.items()])


def levels_of(df: DataFrame, col: str, at_most: int = 5_000) -> list:
    """Sorted distinct values of a categorical column; refuses a column that is not one."""
    found = [r[0] for r in df.select(col).distinct().limit(at_most + 1).collect() if r[0] is not None]
    if len(found) > at_most:
        raise ValueError(f"{col} has more than {at_most} levels")
    return sorted(found)


def dummies(df: DataFrame, col: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every level but the smallest."""
    levels = levels_of(df, col)[1:]
    names = [f"{prefix}_{v}" for v in levels]
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("double").alias(n) for v, n in zip(levels, names)]), names


def group_means(df: DataFrame, by: str, cols: Sequence[str], prefix: str = "cm_") -> DataFrame:
    """Add the group mean of each column to every row."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(prefix + c) for c in cols])
    return lookup_join(df, means, [by])


def target_rates(df: DataFrame, by: str, outcome: str, fit_on: Column,
                 smoothing: float = SMOOTHING) -> tuple[DataFrame, float]:
    """Per group (sum + smoothing * prior) / (n + smoothing) over the fitting rows, and the prior."""
    fit = df.filter(fit_on)
    prior = fit.agg(F.avg(outcome)).first()[0]
    rate = (F.sum(outcome) + F.lit(smoothing * prior)) / (F.count(outcome) + F.lit(smoothing))
    return fit.groupBy(by).agg(rate.alias("rate")), prior


def target_encode(df: DataFrame, by: str, outcome: str, fit_on: Column, out: str = "city_rate",
                  smoothing: float = SMOOTHING) -> DataFrame:
    """Add the smoothed rate of the row's group; groups unseen in the fitting rows get the prior."""
    rates, prior = target_rates(df, by, outcome, fit_on, smoothing)
    joined = lookup_join(df, rates, [by])
    return joined.withColumn(out, F.coalesce("rate", F.lit(prior))).drop("rate")


def construct_scores(mode: str = "count") -> dict[str, Column]:
    """Raw construct scores: log1p of hits, density, or presence."""
    if mode == "count":
        return {c: log1p_floor(F.col(f"hits_{c}")) for c in CONSTRUCTS}
    return {c: F.col(f"{mode}_{c}").cast("double") for c in CONSTRUCTS}


def design_matrix(df: DataFrame, mode: str = "count", city_means: bool = True, city_levels: bool = False,
                  keep: Sequence[str] = ("city_id", "y_revisit", "y_continue")) -> tuple[DataFrame, list[str]]:
    """z-scored constructs, sentiment and controls, period flag, city means (of raw hits in every mode),
    year dummies and, if asked, city dummies. Returns the rows and the regressor names, BI among them."""
    raw = {**construct_scores(mode), "SENT": F.col("vader_compound"), "log_len": log1p_floor(F.col("n_tokens")),
           "log_prior": log1p_floor(F.col("listing_prior_reviews")),
           "log_age": log1p_floor(F.col("listing_age_days"))}
    stats = moments(df, raw)
    cols = [scaled(e, *stats[n]).alias(n) for n, e in raw.items()] + [F.col("covid").cast("double").alias("covid")]
    names = list(raw) + ["covid"]
    source = df
    if city_means:
        hits = [f"hits_{c}" for c in CONSTRUCTS]
        table = df.groupBy("city_id").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(h).alias(f"cm_{h}") for h in hits])
        weighted = table.agg(F.sum("_n").alias("n"), *[f for h in hits for f in (
            F.sum(F.col("_n") * F.col(f"cm_{h}")).alias(f"s_{h}"),
            F.sum(F.col("_n") * F.pow(f"cm_{h}", F.lit(2))).alias(f"q_{h}"))]).first()
        for c, h in zip(CONSTRUCTS, hits):
            mean = weighted[f"s_{h}"] / weighted["n"]
            sd = max(weighted[f"q_{h}"] / weighted["n"] - mean * mean, 0.0) ** 0.5
            table = table.withColumn(f"cm_{c}", scaled(F.col(f"cm_{h}"), mean, sd))
        source = lookup_join(df, table.select("city_id", *[f"cm_{c}" for c in CONSTRUCTS]), ["city_id"])
        names += [f"cm_{c}" for c in CONSTRUCTS]
        cols += [F.col(f"cm_{c}") for c in CONSTRUCTS]
    for col, prefix, wanted in (("year", "yr", True), ("city_id", "city", city_levels)):
        if wanted:
            for level in levels_of(df, col)[1:]:
                names.append(f"{prefix}_{level}")
                cols.append((F.col(col) == F.lit(level)).cast("double").alias(f"{prefix}_{level}"))
    return source.select(*keep, *cols), names


def feature_matrix(df: DataFrame, outcome: str, fit_on: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The 16 model features: unscaled constructs, sentiment, controls and the city rate of the fitting rows."""
    rated = target_encode(df, "city_id", outcome, fit_on)
    values = {**construct_scores(), "SENT": F.col("vader_compound"), "vader_pos": F.col("vader_pos"),
              "vader_neg": F.col("vader_neg"), "log_len": log1p_floor(F.col("n_tokens")),
              "n_exclaim": log1p_floor(F.col("n_exclaim")),
              "log_prior": log1p_floor(F.col("listing_prior_reviews")),
              "log_age": log1p_floor(F.col("listing_age_days")), "covid": F.col("covid").cast("double"),
              "month_sin": month_sin(F.col("month")), "month_cos": month_cos(F.col("month")),
              "city_rate": F.col("city_rate")}
    return rated.select(*keep, F.col(outcome).alias("y"), *[values[f].alias(f) for f in FEATURES])
