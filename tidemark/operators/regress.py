"""Least squares and logit with cluster-robust errors.

Every pass sums K x K blocks on the executors, first per partition in numpy, then, where there are many partitions, in a few
tasks that add up blocks as they arrive; group x K sums go through a combinable group-by. Only K x K numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import coefficient_cell, stars
from tidemark.operators.features import ANTECEDENTS, design_matrix, group_means, levels_of
from tidemark.operators.skew import lookup_join

CONST = "const"
# Display names of the coefficient table, in its row order.
LABELS = {
    "BI": "Revisit intention (BI)",
    "ATT": "Attitude",
    "SN": "Subjective norm",
    "PBC": "Perceived behavioural control",
    "SAT": "Satisfaction",
    "SENT": "Sentiment (VADER)",
    "covid": "During COVID-19",
    "log_len": "Review length (log)",
    "log_prior": "Listing prior reviews (log)",
    "log_age": "Listing age (log)",
    "const": "Constant",
}
PATHS = ["BI->Y"] + [f"{c}->BI" for c in ANTECEDENTS] + [f"{c}->Y" for c in ANTECEDENTS]


class NotConverged(RuntimeError):
    """The logit did not reach a maximum; its numbers must not be reported."""


@dataclass
class Fit:
    """Coefficients with their covariance, and the sums a report needs."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    groups: int
    stats: dict[str, float] = field(default_factory=dict)
    left_out: list[tuple[str, str, int]] = field(default_factory=list)      # (name, why, rows that went with it)

    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def row(self, name: str) -> tuple[float, float, float]:
        """Coefficient, standard error and two-sided normal p."""
        k = self.names.index(name)
        b, s = float(self.beta[k]), float(np.sqrt(self.cov[k, k]))
        return b, s, normal_p(b / s) if s else float("nan")

    def table(self, spark) -> DataFrame:
        rows = [(n, *self.row(n)) for n in self.names]
        return spark.createDataFrame(rows, "variable string, coef double, se double, p double")


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _matrix(batch: pa.RecordBatch, positions: Iterable[int]) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in positions])


#: Blocks of more partitions than this are added up by tasks before the driver adds the rest.
FEW_BLOCKS = 64


def add_blocks(blocks: DataFrame, size: int, partitions: int | None = None) -> np.ndarray:
    """Sum of the `block` column (bytes of `size` doubles); `partitions` is their number, if it is known."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["block"])

    if partitions is None or partitions > FEW_BLOCKS:
        tasks = min(32, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        blocks = blocks.repartition(tasks).mapInArrow(add, "block binary")
    return np.sum([np.zeros(size), *(np.frombuffer(r[0]) for r in blocks.collect())], axis=0)


def _sum_cells(df: DataFrame, cols: Sequence[str], block, size: int, partitions: int | None = None) -> np.ndarray:
    """Sum block(X) over all rows, where block returns `size` numbers for a batch X."""
    cols = list(cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += block(_matrix(batch, range(len(cols))))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["block"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return add_blocks(rows.mapInArrow(partial, "block binary"), size, partitions)


#: Rows that one task of a pass takes at least, where there are more tasks than cores.
TASK_ROWS = 100_000


def compact(df: DataFrame) -> DataFrame:
    """The rows in no more partitions than cores or their number ask for; a fit makes many passes, each with a task a partition.

    Rows are counted, in one pass, and not shuffled; partitions are put together.
    """
    enough = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.coalesce(enough) if df.rdd.getNumPartitions() > enough else df


def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """X'X of the columns."""
    k = len(cols)
    return _sum_cells(df, cols, lambda x: (x.T @ x).ravel(), k * k).reshape(k, k)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solution, so a redundant column does not stop the fit."""
    return np.linalg.pinv(a, hermitian=True, rcond=1e-12) @ b


def _with_const(df: DataFrame) -> DataFrame:
    return df.withColumn(CONST, F.lit(1.0))


def cluster_cov(df: DataFrame, x: Sequence[str], beta: np.ndarray, y: str, group: str, bread: np.ndarray,
                logit: bool, n: int, small_sample: bool = True) -> tuple[np.ndarray, int]:
    """Sandwich covariance with scores summed per group, and the number of groups."""
    x, k = list(x), len(x)

    columns = [group, *dict.fromkeys([*x, y])]
    at = [columns.index(c) for c in x]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            m = _matrix(batch, at)
            fitted = m @ beta
            if logit:
                fitted = 1.0 / (1.0 + np.exp(-fitted))
            s = m * (_matrix(batch, [columns.index(y)])[:, 0] - fitted)[:, None]
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            sums = [np.bincount(codes, weights=s[:, j], minlength=len(coded.dictionary)) for j in range(k)]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, sums)], ["_g", *x])

    schema = ", ".join([f"`_g` {dict(df.dtypes)[group]}"] + [f"`{c}` double" for c in x])
    rows = df.select(group, *[F.col(c).cast("double").alias(c) for c in columns[1:]])
    per_group = rows.mapInArrow(scores, schema).groupBy("_g").agg(*[F.sum(c).alias(c) for c in x])
    meat = _sum_cells(per_group, x, lambda s: np.append((s.T @ s).ravel(), len(s)), k * k + 1)
    groups = int(meat[-1])
    inverse = np.linalg.pinv(bread, hermitian=True, rcond=1e-12)
    cov = inverse @ meat[:-1].reshape(k, k) @ inverse
    if small_sample:
        cov *= groups / (groups - 1) * (n - 1) / (n - k)
    return cov, groups


def ols(df: DataFrame, y: str, x: Sequence[str], group: str, small_sample: bool = True) -> Fit:
    """Least squares with a constant, errors clustered by `group`."""
    rows, names = _with_const(df), [CONST, *x]
    k = len(names)
    g = gram(rows, [*names, y])
    beta = _solve(g[:k, :k], g[:k, k])
    n = int(round(g[0, 0]))
    cov, groups = cluster_cov(rows, names, beta, y, group, g[:k, :k], False, n, small_sample)
    rss = float(g[k, k] - beta @ g[:k, k])
    tss = float(g[k, k] - g[0, k] ** 2 / n)
    return Fit(names, beta, cov, n, groups, {"rss": rss, "r2": 1 - rss / tss, "mean": float(g[0, k] / n)})


#: Least mean of p (1 - p) along any direction of the regressors, relative to that of an outcome with the same base rate.
VANISHED = 1e-6


def set_aside(rows: DataFrame, names: Sequence[str], y: str, partitions: int | None = None) -> tuple[DataFrame, list[str], list[tuple[str, str, int]]]:
    """Leave out regressors that are constant, and 0/1 regressors one value of which fixes the outcome, with that value's rows.

    Such a regressor has no finite coefficient, and its rows tell nothing about the others. The rest is
    looked at again until nothing is found, one pass each time. A column of nulls only is constant;
    one with some nulls is refused. Returns rows, names and what was left out.
    """
    names, gone = list(names), []
    while True:
        k = len(names)
        first = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).first()
        if first is None or not k:
            return rows, names, gone
        start = np.array([np.nan if v is None else v for v in first])

        def block(m: np.ndarray) -> np.ndarray:
            x, t = m[:, :k], m[:, k]
            return np.concatenate([np.isnan(x).sum(axis=0), np.abs(x - start).sum(axis=0), np.abs(x * (x - 1)).sum(axis=0),
                                   x.sum(axis=0), x.T @ t, [len(t), t.sum()]])

        found = _sum_cells(rows, [*names, y], block, 5 * k + 2, partitions)
        n, positives = found[-2:]
        drop, keep = [], F.lit(True)
        for j, name in enumerate(names):
            nulls, moved, apart, ones, hits = found[j:5 * k:k]
            if 0 < nulls < n:
                raise ValueError(f"{name} is null in {int(nulls)} of {int(n)} rows")
            if nulls or moved == 0:
                drop.append(name)
                gone.append((name, "constant", 0))
            elif apart == 0 and hits in (0, ones):
                drop.append(name)
                gone.append((name, "1 fixes the outcome", int(ones)))
                keep = keep & (F.col(name) == 0)
            elif apart == 0 and positives - hits in (0, n - ones):
                drop.append(name)
                gone.append((name, "0 fixes the outcome", int(n - ones)))
                keep = keep & (F.col(name) == 1)
        if not drop:
            return rows, names, gone
        rows, names = rows.filter(keep), [c for c in names if c not in drop]


def directions(hess: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weights d'Hd / d'Gd of the directions that the rows span, least first, and these directions, of length 1 in G."""
    size = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    level, axes = np.linalg.eigh(gram / np.outer(size, size))
    own = level > 1e-10 * max(level.max(initial=0.0), 1e-300)
    base = axes[:, own] / np.sqrt(level[own]) / size[:, None]
    values, vectors = np.linalg.eigh(base.T @ hess @ base)
    return values, base @ vectors


def weakest_direction(hess: np.ndarray, gram: np.ndarray) -> tuple[float, np.ndarray]:
    """Least mean weight over the directions that the rows span, and that direction."""
    values, found = directions(hess, gram)
    return (float(values[0]), found[:, 0]) if len(values) else (0.0, np.zeros(len(gram)))


def named_direction(direction: np.ndarray, gram: np.ndarray, names: Sequence[str]) -> str:
    """The regressors that make up a direction, largest share first."""
    share = np.abs(direction) * np.sqrt(np.abs(np.diag(gram)))
    order = [j for j in np.argsort(-share) if share[j] > 0.05 * share.max()]
    return ", ".join(f"{direction[j] / np.abs(direction).max():+.2f} {names[j]}" for j in order[:8])


class Newton:
    """Newton steps for a concave log-likelihood, halved where it falls, with a guard against separation.

    `evaluate(beta)` returns the negative Hessian, the gradient and the log-likelihood, at beta = 0 first. The
    Hessian there is a quarter of the Gram matrix, which the guard compares with: under separation the weights
    p (1 - p) vanish along some direction of the regressors, and its steps never do.

    With `limit` such directions are followed until the score equations vanish: the likelihood is then at its least upper
    bound, and coefficients without a part in them are at their values there. `endless` holds the directions, one a column.
    """

    def __init__(self, evaluate, names: Sequence[str], y: str, n: float, rate: float, gram: np.ndarray, start: tuple, limit: bool = False):
        self.evaluate, self.names, self.y, self.n, self.gram, self.limit = evaluate, list(names), y, n, gram, limit
        self.least = VANISHED * 4 * rate * (1 - rate)
        self.beta, (self.hess, self.grad, self.ll) = np.zeros(len(names)), start
        self.endless = np.zeros((len(names), 0))

    def separated(self) -> None:
        values, found = directions(self.hess, self.gram)
        if self.limit and len(values) > 1 and values[-1] > self.least:
            self.endless = found[:, values <= self.least]
        elif not len(values) or values[0] <= self.least:
            direction = found[:, 0] if len(values) else np.zeros(len(self.names))
            raise NotConverged(f"logit of {self.y}: the outcome is separated along {named_direction(direction, self.gram, self.names)}")

    def not_finite(self) -> np.ndarray:
        """Whether each coefficient has a part in a direction without an end."""
        share = np.abs(self.endless) * np.sqrt(np.abs(np.diag(self.gram)))[:, None]
        return (share > 1e-3 * share.max(axis=0, initial=0.0)).any(axis=1)

    def run(self, max_iter: int, tol: float) -> None:
        scale = np.sqrt(np.abs(np.diag(self.gram)) / max(self.n, 1))
        for _ in range(max_iter):
            self.separated()
            step = _solve(self.hess, self.grad)
            ending = step - self.endless @ (self.endless.T @ self.gram @ step)
            if np.abs(self.grad).max(initial=0) <= tol * self.n and np.abs(ending * scale).max(initial=0) <= 1e-6:
                return
            size = 1.0
            while True:
                trial = self.evaluate(self.beta + size * step, size)
                if trial[2] >= self.ll - 1e-12 * abs(self.ll) or size < 1e-6:
                    break
                size /= 2
            self.beta = self.beta + size * step
            self.hess, self.grad, self.ll = trial
        raise NotConverged(f"logit of {self.y} did not converge in {max_iter} steps")


def logit_stats(ll: float, n: float, positives: float, k: int, gradient: float) -> dict[str, float]:
    rate = positives / n
    ll0 = positives * math.log(rate) + (n - positives) * math.log(1 - rate)
    return {"ll": ll, "ll0": ll0, "pseudo_r2": 1 - ll / ll0, "aic": -2 * ll + 2 * k, "bic": -2 * ll + k * math.log(n),
            "mean": rate, "gradient": gradient}


def logit(df: DataFrame, y: str, x: Sequence[str], group: str, max_iter: int = 200, tol: float = 1e-9,
          small_sample: bool = True, leave_out: bool = False, limit: bool = False) -> Fit:
    """Maximum likelihood by Newton steps, one pass over the cached rows per step.

    A step that lowers the likelihood is halved. Raises NotConverged when the steps or the gradient do not vanish, or
    when the outcome is separated along some direction of the regressors, which the message names. With
    `leave_out`, constant regressors and 0/1 regressors that fix the outcome are set aside first and reported in the fit. With
    `limit`, a separated outcome is not refused as long as some direction isn't: all rows stay, the fit is the one that the
    likelihood tends to, coefficients that grow without end are NaN, and the directions are reported.
    """
    columns = list(dict.fromkeys([CONST, *x, y]))
    rows = _with_const(df).select(group, *[F.col(c).cast("double").alias(c) for c in columns]).persist()
    try:
        partitions = rows.rdd.getNumPartitions()
        used, own, gone = set_aside(rows, x, y, partitions) if leave_out else (rows, list(x), [])
        names, k = [CONST, *own], len(own) + 1

        def sums(beta: np.ndarray) -> np.ndarray:
            def block(m: np.ndarray) -> np.ndarray:
                z, t = m[:, :k], m[:, k]
                eta = z @ beta
                p = 1.0 / (1.0 + np.exp(-eta))
                hess = (z * (p * (1 - p))[:, None]).T @ z
                ll = float(t @ eta - np.logaddexp(0.0, eta).sum())
                return np.concatenate([hess.ravel(), z.T @ (t - p), [ll, len(t), t.sum()]])
            return _sum_cells(used, [*names, y], block, k * k + k + 3, partitions)

        def parts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            return s[:k * k].reshape(k, k), s[k * k:k * k + k], float(s[-3])

        begun = sums(np.zeros(k))
        n, positives = float(begun[-2]), float(begun[-1])
        if not 0 < positives < n:
            raise NotConverged(f"logit of {y}: the outcome does not vary")
        search = Newton(lambda b, _size: parts(sums(b)), names, y, n, positives / n, 4 * parts(begun)[0], parts(begun), limit)
        search.run(max_iter, tol)
        cov, groups = cluster_cov(used, names, search.beta, y, group, search.hess, True, int(n), small_sample)
        stats = logit_stats(search.ll, n, positives, k, float(np.abs(search.grad).max()))
        endless = search.not_finite()
        cov[endless, :] = cov[:, endless] = np.nan
        gone = gone + [(named_direction(d, search.gram, names), "separated, no finite coefficient", 0) for d in search.endless.T]
        return Fit(names, np.where(endless, np.nan, search.beta), cov, int(n), groups, stats, gone)
    finally:
        rows.unpersist()


@dataclass
class PairFit:
    """Intention equation, behaviour equation and what the sample lost before the fit: (what, why, rows)."""

    outcome: str
    intention: Fit
    behaviour: Fit
    left_out: list[tuple[str, str, int]] = field(default_factory=list)


def fit_pair(df: DataFrame, outcome: str, mode: str = "count", city_means: bool = True,
             city_levels: bool = False, max_iter: int = 200, city_effects: bool = False, limit: bool = False) -> PairFit:
    """BI on its antecedents and the outcome on BI and all antecedents, on one design matrix.

    Constant regressors and dummies that fix the outcome are left out of the behaviour equation with their rows. City
    effects are dummies with `city_levels`, for a few cities, or are eliminated with `city_effects`, for any number. Cities
    whose outcome never varies are then left out first, since their effect is not finite; if the fit
    still fails, cities under 2 and then 5 positives go, and what does not converge after that is refused.
    The returned fit tells the cities, regressors and rows that were left out. With `limit`, which says nothing on
    eliminated effects, an outcome separated along some directions is fitted as `logit` tells.
    """
    from tidemark.operators.absorbed import logit_absorbed, ols_absorbed
    by_city = city_levels or city_effects
    used, lost = (_cities_out(df, vary_within(df, "city_id", outcome), "the outcome does not vary")) if by_city else (df, [])
    for positives in (2, 5, None):
        matrix, names = design_matrix(used, mode, city_means and not by_city, city_levels)
        matrix = compact(matrix).persist()
        others = [n for n in names if n != "BI"]
        try:
            if city_effects:
                behaviour = logit_absorbed(matrix, outcome, names, "city_id", max_iter)
                intention = ols_absorbed(matrix, "BI", others, "city_id")
            else:
                behaviour = logit(matrix, outcome, names, "city_id", max_iter, leave_out=True, limit=limit)
                intention = ols(matrix, "BI", others, "city_id")
            return PairFit(outcome, intention, behaviour, [*lost, *behaviour.left_out])
        except NotConverged:
            if positives is None or not by_city:
                raise
            used, more = _cities_out(used, at_least_positives(used, "city_id", outcome, positives), f"under {positives} positives")
            lost = lost + more
        finally:
            matrix.unpersist()
    raise NotConverged(outcome)


def _cities_out(before: DataFrame, after: DataFrame, why: str) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """`after`, and how many cities and rows it lacks of `before`."""
    counts = [d.agg(F.countDistinct("city_id"), F.count(F.lit(1))).first() for d in (before, after)]
    cities, rows = (a - b for a, b in zip(*counts))
    return after, [(f"{cities} cities", why, rows)] if rows else []


def vary_within(df: DataFrame, by: str, outcome: str) -> DataFrame:
    """Rows of the groups in which the outcome takes at least two values."""
    groups = df.groupBy(by).agg(F.countDistinct(outcome).alias("_v")).filter(F.col("_v") >= 2)
    return lookup_join(df, groups.select(by), [by], "left_semi")


def at_least_positives(df: DataFrame, by: str, outcome: str, least: int) -> DataFrame:
    """Rows of the groups with at least `least` positive outcomes."""
    groups = df.groupBy(by).agg(F.sum(outcome).alias("_p")).filter(F.col("_p") >= least)
    return lookup_join(df, groups.select(by), [by], "left_semi")


def pair_table(spark, pair: PairFit) -> DataFrame:
    """variable, eq1_BI, eq2_behaviour; a cell is empty where the variable is not in the equation."""
    rows = []
    for order, (name, label) in enumerate(LABELS.items()):
        left = pair.intention.row(name) if name in pair.intention.names else (None, None, None)
        right = pair.behaviour.row(name) if name in pair.behaviour.names else (None, None, None)
        rows.append((order, label, *left, *right))
    raw = spark.createDataFrame(
        rows, "ord int, variable string, c1 double, s1 double, p1 double, c2 double, s2 double, p2 double")
    return raw.select("ord", "variable", *[
        F.coalesce(coefficient_cell(F.col(f"c{k}"), F.col(f"s{k}"), F.col(f"p{k}")), F.lit("")).alias(name)
        for k, name in ((1, "eq1_BI"), (2, "eq2_behaviour"))]).orderBy("ord").drop("ord")


def pair_record(pair: PairFit) -> dict[str, tuple[float, float, float]]:
    """The nine reported paths as (coefficient, error, p)."""
    return {p: (pair.behaviour if p.endswith("->Y") else pair.intention).row(p.split("->")[0]) for p in PATHS}


def left_out_table(spark, runs: Sequence[tuple[str, PairFit, float]]) -> DataFrame:
    """What each specification lost: spec, outcome, what (a regressor or a number of cities), why, rows."""
    rows = [(spec, pair.outcome, *lost) for spec, pair, _ in runs for lost in pair.left_out]
    return spark.createDataFrame(rows, "spec string, outcome string, what string, why string, rows long")


def run_summary(spark, runs: Sequence[tuple[str, PairFit, float]]) -> DataFrame:
    """One row per (spec, fit, seconds): sample, base rate, fit statistics and the nine paths, null where one has no finite coefficient."""
    rows = []
    for spec, pair, seconds in runs:
        b = pair.behaviour
        record = pair_record(pair)
        flat = [None if math.isnan(record[p][0]) else v for p in PATHS for v in record[p]]
        rows.append((spec, pair.outcome, b.n, b.groups, b.stats["mean"], seconds, pair.intention.stats["r2"],
                     b.stats["pseudo_r2"], b.stats["aic"], b.stats["bic"], *flat))
    head = ("spec string, outcome string, N long, cities long, base_rate double, seconds double, eq1_r2 double, "
            "eq2_pseudo_r2 double, aic double, bic double")
    tail = ", ".join(f"c{i} double, s{i} double, p{i} double" for i in range(len(PATHS)))
    raw = spark.createDataFrame(rows, f"{head}, {tail}")
    return raw.select("spec", "outcome", "N", "cities", F.round("base_rate", 5).alias("base_rate"),
                      F.round("seconds", 1).alias("seconds"), F.round("eq1_r2", 4).alias("eq1_r2"),
                      F.round("eq2_pseudo_r2", 5).alias("eq2_pseudo_r2"), F.round("aic", 2).alias("aic"),
                      F.round("bic", 2).alias("bic"), *[
                          coefficient_cell(F.col(f"c{i}"), F.col(f"s{i}"), F.col(f"p{i}")).alias(p)
                          for i, p in enumerate(PATHS)])


def mediation(spark, pair: PairFit, draws: int = 5000, seed: int = 20260901) -> DataFrame:
    """Indirect, direct and total effect of each antecedent, with a Monte-Carlo interval for a * b."""
    b, sb, _ = pair.behaviour.row("BI")
    rows = [(i, LABELS[c], *pair.intention.row(c)[:2], b, sb, *pair.behaviour.row(c))
            for i, c in enumerate(ANTECEDENTS)]
    paths = spark.createDataFrame(rows, "ord int, antecedent string, a double, sa double, b double, sb double, "
                                        "direct double, sd double, direct_p double")
    drawn = spark.range(draws).select(F.randn(seed).alias("za"), F.randn(seed + 1).alias("zb"), *[
        F.explode(F.sequence(F.lit(0), F.lit(len(ANTECEDENTS) - 1))).alias("ord")])
    limits = (drawn.join(F.broadcast(paths), "ord")   # four rows
              .withColumn("ab", (F.col("a") + F.col("sa") * F.col("za")) * (F.col("b") + F.col("sb") * F.col("zb")))
              .groupBy("ord").agg(F.percentile("ab", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")))
    out = paths.join(limits, "ord")
    return out.select(
        "antecedent", "a", "b", (F.col("a") * F.col("b")).alias("indirect"), F.col("ci")[0].alias("ci_lo"),
        F.col("ci")[1].alias("ci_hi"), "direct", "direct_p",
        (F.col("a") * F.col("b") + F.col("direct")).alias("total"),
        mediation_type(F.col("a") * F.col("b"), F.col("ci")[0], F.col("ci")[1], F.col("direct"),
                       F.col("direct_p")).alias("mediation_type"))


def mediation_type(indirect, lo, hi, direct, direct_p):
    """Five-way label from the signs and significance of the two effects."""
    mediated, has_direct = lo * hi > 0, direct_p < .05
    return (F.when(mediated & has_direct & (indirect * direct > 0), "complementary (partial)")
            .when(mediated & has_direct, "competitive (inconsistent)")
            .when(mediated, "indirect-only (full)").when(has_direct, "direct-only").otherwise("no effect"))


def simple_slopes(df: DataFrame, y: str, x: Sequence[str], by: str) -> DataFrame:
    """(group, n, slope of y on each x taken alone), for a first look per group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.regr_slope(y, c).alias(f"slope_{c}") for c in x])


def within_group_ols(df: DataFrame, y: str, x: Sequence[str], by: str) -> np.ndarray:
    """Slopes with one intercept per group, by removing group means instead of adding dummies."""
    means = group_means(df.select(by, y, *x), by, [y, *x], "m_")
    centred = means.select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in [*x, y]])
    g = gram(centred, [*x, y])
    k = len(x)
    return _solve(g[:k, :k], g[:k, k])


STRATA = (15, 40, 70, 120)


def length_stratum(n_tokens):
    """15-40, 40-70, 70-120 or 120+ tokens, half open."""
    labels = [f"{a}-{b}" for a, b in zip(STRATA, STRATA[1:])] + [f"{STRATA[-1]}+"]
    pick = F.lit(None).cast("string")
    for low, label in zip(STRATA, labels):
        pick = F.when(n_tokens >= low, label).otherwise(pick)
    return pick


def strata_fits(df: DataFrame, stratum: str, y: str, x: Sequence[str], group: str) -> list[tuple[str, Fit]]:
    """OLS of y on x in every stratum and over all rows; the strata are a fixed short list."""
    rows = df.persist()
    names = levels_of_strata(rows, stratum)
    fits = [(s, ols(rows.filter(F.col(stratum) == s), y, x, group)) for s in names] + [("ALL", ols(rows, y, x, group))]
    rows.unpersist()
    return fits


def strata_table(spark, fits: Sequence[tuple[str, Fit]], x: Sequence[str]) -> DataFrame:
    """stratum, n and one signed cell with stars (`-0.0975***`) per regressor."""
    rows = [(s, f.n, *[v for c in x for v in (f.row(c)[0], f.row(c)[2])]) for s, f in fits]
    raw = spark.createDataFrame(rows, "stratum string, n long, " + ", ".join(
        f"c{i} double, p{i} double" for i in range(len(x))))
    return raw.select("stratum", "n", *[
        F.concat(F.format_string("%+.4f", f"c{i}"), stars(F.col(f"p{i}"))).alias(c) for i, c in enumerate(x)])


def levels_of_strata(df: DataFrame, stratum: str) -> list[str]:
    return sorted(levels_of(df, stratum), key=lambda s: int(s.rstrip("+").split("-")[0]))
