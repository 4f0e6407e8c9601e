"""Exact quantiles, quantile bins and tie-averaged ranks over whole columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalar import SEED, hash32
from tidemark.operators.skew import running_before


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, n) over the non-missing values, combined before the shuffle."""
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    return (long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))


def ranked_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, n, before_n, avg_rank) with ranks averaged over ties, from 1."""
    ranked = running_before(value_counts(df, cols), ["value"], ["n"], within=["variable"])
    return ranked.withColumn("avg_rank", F.col("before_n") + (F.col("n") + 1) / F.lit(2.0))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(variable, prob, quantile), interpolated linearly between order statistics."""
    ranked = running_before(value_counts(df, cols), ["value"], ["n"], within=["variable"])
    return pick_quantiles(ranked, ["variable"], probs)


def pick_quantiles(ranked: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from rows (by, value, n, before_n): only the rows that hold a wanted position survive.

    `by` names reported series (variables, models), so the table of wanted positions is small.
    """
    by = list(by)
    totals = ranked.groupBy(*by).agg(F.sum("n").alias("_total"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    targets = (totals.select(*by, "_total", wanted)
               .withColumn("_at", (F.col("_total") - 1) * F.col("prob"))
               .withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at"))
               .groupBy(*by).agg(F.collect_list(F.struct("prob", "_at", "_lo", "_hi")).alias("_targets")))

    def holds(position: Column) -> Column:
        return (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))

    found = F.filter("_targets", lambda t: holds(t["_lo"]) | holds(t["_hi"]))
    series = F.broadcast(targets)
    hits = ranked.join(series, by).withColumn("_t", F.explode(found))
    return (hits.groupBy(*by, "_t.prob")
            .agg(F.max(F.when(holds(F.col("_t._lo")), F.col("value"))).alias("_v_lo"),
                 F.max(F.when(holds(F.col("_t._hi")), F.col("value"))).alias("_v_hi"),
                 F.first("_t._at").alias("_at"), F.first("_t._lo").alias("_lo"))
            .select(*by, "prob", (F.col("_v_lo") + (F.col("_at") - F.col("_lo")) * (F.col("_v_hi") - F.col("_v_lo")))
                    .alias("quantile")))


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """The quantiles of each column as plain numbers: len(cols) x len(probs) values."""
    found = {(r["variable"], r["prob"]): r["quantile"] for r in quantiles(df, cols, probs).collect()}
    return {c: [found[c, float(p)] for p in probs if (c, float(p)) in found] for c in cols}


def bin_index(col: Column, edges: Sequence[float]) -> Column:
    """0-based bin of `col` among right-closed bins; the lowest edge belongs to the first bin."""
    index = F.lit(0)
    for edge in edges[1:-1]:
        index = index + (col > F.lit(edge)).cast("int")
    return F.when(col.isNotNull(), index)


def quantile_bins(df: DataFrame, col: str, bins: int, out: str = "bin") -> DataFrame:
    """Add the 0-based quantile bin of `col`; equal edges are merged."""
    probs = [k / bins for k in range(bins + 1)]
    edges = sorted(set(quantile_values(df, [col], probs)[col]))
    return df.withColumn(out, bin_index(F.col(col), edges))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement, the ones with the smallest hash of `key`.

    A histogram over the leading hash bits finds the bucket where the n-th row falls; rows
    of earlier buckets are kept by a plain filter and only that bucket is sorted.
    """
    hashed = df.withColumn("_h", hash32(F.col(key), seed))
    bucket = F.shiftright("_h", 16)
    taken, cut, room = 0, None, 0
    for b, rows in hashed.groupBy(bucket.alias("b")).count().orderBy("b").collect():   # at most 65,536 rows
        if taken + rows >= n:
            cut, room = b, n - taken
            break
        taken += rows
    if cut is None:
        return df
    last = hashed.filter(bucket == cut).orderBy("_h", key).limit(room)
    return hashed.filter(bucket < cut).unionByName(last).drop("_h")


def top_groups(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of the n largest groups; equal sizes are ordered by name."""
    largest = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), by).limit(n)
    return df.join(F.broadcast(largest.select(by)), by, "left_semi")


def running_centred(df: DataFrame, by: Sequence[str], order: str, effect: str, out: str) -> DataFrame:
    """Running sum of `effect` within a short series, centred on its plain mean."""
    series = W.partitionBy(*by)
    total = df.withColumn(out, F.sum(effect).over(series.orderBy(order)))
    return total.withColumn(out, F.col(out) - F.avg(out).over(series))
