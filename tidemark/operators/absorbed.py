"""Regression with one effect per group, eliminated instead of written out as dummies.

A Newton step with effects a_g and slopes b has a Hessian whose effect block is diagonal. Every group needs the
sum h of its weights, the sum s of its residuals and the vector v of its weighted regressors only, and the slopes' step
solves the Schur complement

    (A - sum v v' / h) db = r - sum v s / h,        da_g = (s_g - v_g'db) / h_g

with A and r summed over all rows. The vectors of all groups stay on the executors, in a table that is written once per step and
carries the effects to the next; the driver sees K x K numbers. So the number of groups has no limit. Rows are range
partitioned by group and a hash once, which splits a group of any size over partitions and leaves few groups in each.

Errors are clustered by the same group. Rows with a null group take no part. The slopes, their covariance and the
likelihood equal those of a fit with a dummy for every group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.regress import (Fit, Newton, NotConverged, _matrix, _solve, _sum_cells, add_blocks, logit_stats, set_aside)
from tidemark.operators.skew import BROADCAST_ROWS, lookup_join
from tidemark.session import checkpointed

KEY = "_by"


def _spread(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    rows = df.filter(F.col(by).isNotNull()).select(F.col(by).alias(KEY), *[F.col(c).cast("double").alias(c) for c in cols])
    return rows.repartitionByRange(KEY, F.xxhash64(*cols)).persist()


def _group_sums(rows: DataFrame, cols: Sequence[str], per_row, whole, size: int,
                width: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Per group the sums of per_row(X) (`width` numbers a row), the sum of whole(X) (`size` numbers) over all rows, and
    the cached sums per partition that both come from.

    There is one pass: a partition adds its groups up, and puts its part of the whole beside them under no group.
    """
    cols, kind = list(cols), dict(rows.dtypes)[KEY]
    fields = [f"s{j}" for j in range(width)]
    n = 1 + len(cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, groups = np.zeros(size), {}
        keys_type = None
        for batch in batches:
            keys_type = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            m = _matrix(batch, range(1, n))
            total += whole(m)
            coded = batch.column(0).dictionary_encode()
            values = per_row(m)
            sums = np.stack([np.bincount(coded.indices.to_numpy(), weights=values[:, j], minlength=len(coded.dictionary))
                             for j in range(width)], axis=1)
            for key, own in zip(coded.dictionary.to_pylist(), sums):
                groups[key] = groups[key] + own if key in groups else own
        if keys_type is None:
            return
        table = np.array(list(groups.values())).reshape(len(groups), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*groups, None], keys_type), *(pa.array([*column, None], pa.float64()) for column in table.T.tolist()),
             pa.array([*[None] * len(groups), total.tobytes()], pa.binary())], [KEY, *fields, "block"])

    schema = f"`{KEY}` {kind}, " + ", ".join(f"{f} double" for f in fields) + ", block binary"
    partial_sums = rows.select(KEY, *cols).mapInArrow(partial, schema).persist()
    whole_sum = add_blocks(partial_sums.filter(F.col(KEY).isNull()).select("block"), size, rows.rdd.getNumPartitions())
    per_group = partial_sums.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(*[F.sum(f).alias(f) for f in fields])
    return per_group, whole_sum, partial_sums


def _with_effects(rows: DataFrame, effects: DataFrame, groups: int) -> DataFrame:
    """Rows with the effect of their group; `effects` has one row for each of the `groups`, counted before."""
    if groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(effects), KEY)
    return lookup_join(rows, effects, [KEY])


def _spans(table: DataFrame, k: int, first: int, divisor: str) -> np.ndarray:
    """sum over groups of v v' / h, where v are the k columns from s<first> on and h the divisor."""
    cols = [f"s{j}" for j in range(first, first + k)] + [divisor]
    return _sum_cells(table, cols, lambda m: ((m[:, :k] / m[:, k:]).T @ m[:, :k]).ravel(), k * k).reshape(k, k)


def _sandwich(scores: DataFrame, k: int, first: int, bread: np.ndarray, n: int, params: int, small_sample: bool) -> tuple[np.ndarray, int]:
    meat = _sum_cells(scores, [f"s{j}" for j in range(first, first + k)], lambda s: np.append((s.T @ s).ravel(), len(s)), k * k + 1)
    groups = int(meat[-1])
    inverse = np.linalg.pinv(bread, hermitian=True, rcond=1e-12)
    cov = inverse @ meat[:-1].reshape(k, k) @ inverse
    if small_sample and groups > 1 and n > params:
        cov *= groups / (groups - 1) * (n - 1) / (n - params)
    return cov, groups


def ols_absorbed(df: DataFrame, y: str, x: Sequence[str], by: str, small_sample: bool = True) -> Fit:
    """Least squares with one intercept per group, errors clustered by group; two passes."""
    x, k = list(x), len(x)
    rows = _spread(df, by, list(dict.fromkeys([*x, y])))
    held = [rows]
    try:
        at = [*x, y]
        per_group, total, partial = _group_sums(rows, at, lambda m: np.column_stack([np.ones(len(m)), m]),
                                                lambda m: np.append((m.T @ m).ravel(), [len(m), m[:, k].sum()]), (k + 1) ** 2 + 2, k + 2)
        held.append(partial)
        means = checkpointed(per_group)
        n = int(round(total[-2]))
        within = total[:-2].reshape(k + 1, k + 1) - _spans(means, k + 1, 1, "s0")
        beta = _solve(within[:k, :k], within[:k, k])
        # A group's score is the sum of x (residual): its residuals add up to zero, so regressors need no centring.
        intercept = F.col(f"s{k + 1}") / F.col("s0")
        for j in range(k):
            intercept = intercept - F.lit(float(beta[j])) * F.col(f"s{j + 1}") / F.col("s0")
        groups = means.count()
        joined = _with_effects(rows, means.select(KEY, intercept.alias("_a")), groups)

        def residual_scores(m: np.ndarray) -> np.ndarray:
            return m[:, :k] * (m[:, k] - m[:, k + 1] - m[:, :k] @ beta)[:, None]
        scores, _, partial = _group_sums(joined, [*at, "_a"], residual_scores, lambda m: np.zeros(1), 1, k)
        held.append(partial)
        cov, groups = _sandwich(scores, k, 0, within[:k, :k], n, k + groups, small_sample)
        rss = float(within[k, k] - beta @ within[:k, k])
        tss = float(total[:-2].reshape(k + 1, k + 1)[k, k] - total[-1] ** 2 / n)
        return Fit(x, beta, cov, n, groups, {"rss": rss, "r2": 1 - rss / tss, "mean": float(total[-1] / n)})
    finally:
        for d in held:
            d.unpersist()


def _varying(rows: DataFrame, y: str) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """Rows of the groups whose outcome varies, and what the others were."""
    sums = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p"))
    fixed = sums.filter((F.col("_p") == 0) | (F.col("_p") == F.col("_n")))
    groups, lost = fixed.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not groups:
        return rows, []
    return lookup_join(rows, fixed.select(KEY), [KEY], "left_anti"), [(f"{groups} groups", "the outcome does not vary", lost)]


def logit_absorbed(df: DataFrame, y: str, x: Sequence[str], by: str, max_iter: int = 200, tol: float = 1e-9,
                   small_sample: bool = True) -> Fit:
    """Logit with one effect per group, errors clustered by group; one pass over the rows per step.

    Groups whose outcome does not vary, constant regressors and 0/1 regressors that fix the outcome are left out with
    their rows, in turn until none is found, and reported in the fit. Raises NotConverged as `logit` does.
    """
    columns = list(dict.fromkeys([*x, y]))
    source = _spread(df, by, columns)
    held = [source]
    try:
        rows, own, gone = source, list(x), []
        while True:
            rows, fewer, regressors = set_aside(rows, own, y)
            rows, groups = _varying(rows, y)
            gone += regressors + groups
            own = fewer
            if not groups:
                break
        rows = rows.persist()
        held.append(rows)
        k = len(own)
        size = k * k + k + 3
        state: dict = {}

        def sums(effects: DataFrame | None, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
            """Schur complement, reduced gradient and likelihood at these effects; the groups' sums go to `state`."""
            joined = rows.withColumn("_a", F.lit(0.0)) if effects is None else _with_effects(rows, effects, state["groups"])

            def weights(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                eta = m[:, :k] @ beta + m[:, k + 1]
                p = 1.0 / (1.0 + np.exp(-eta))
                return eta, p, p * (1 - p)

            def per_row(m: np.ndarray) -> np.ndarray:
                _, p, w = weights(m)
                u = m[:, k] - p
                return np.column_stack([w, u, m[:, k + 1] * w, m[:, :k] * w[:, None], m[:, :k] * u[:, None]])

            def whole(m: np.ndarray) -> np.ndarray:
                eta, p, w = weights(m)
                z, t = m[:, :k], m[:, k]
                return np.concatenate([((z * w[:, None]).T @ z).ravel(), z.T @ (t - p),
                                       [float(t @ eta - np.logaddexp(0.0, eta).sum()), len(t), t.sum()]])

            per_group, total, partial = _group_sums(joined, [*own, y, "_a"], per_row, whole, size, 3 + 2 * k)
            # The mean of the effect, weighted by the rows' weights, is the effect itself: it is the same in all rows of a group.
            table = checkpointed(per_group.select(KEY, (F.col("s2") / F.col("s0")).alias("_a"), *[f"s{j}" for j in range(3 + 2 * k) if j != 2]))
            partial.unpersist()
            state["table"] = table
            cross = _sum_cells(table, [*[f"s{j}" for j in range(3, 3 + k)], "s0", "s1"], lambda m: np.concatenate([
                ((m[:, :k] / m[:, k:k + 1]).T @ m[:, :k]).ravel(), m[:, :k].T @ (m[:, k + 1] / m[:, k]),
                [np.abs(m[:, k + 1]).sum()]]), k * k + k + 1, table.rdd.getNumPartitions())
            schur = total[:k * k].reshape(k, k) - cross[:k * k].reshape(k, k)
            state["own"], state["counts"] = cross[-1], total[-2:]
            return schur, total[k * k:k * k + k] - cross[k * k:k * k + k], float(total[-3])

        begun = sums(None, np.zeros(k))
        n, positives = (float(v) for v in state["counts"])
        if not 0 < positives < n:
            raise NotConverged(f"logit of {y}: no group's outcome varies")
        state["at"], at, state["groups"] = state["table"], np.zeros(k), state["table"].count()

        def evaluate(beta: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
            nonlocal at
            if share == 1.0:
                state["at"], at = state["table"], beta_of()         # the groups' sums at the point the step starts from
            step = (beta - at) / share
            effect = F.col("s1")
            for j in range(k):
                effect = effect - F.lit(float(step[j])) * F.col(f"s{3 + j}")
            return sums(state["at"].select(KEY, (F.col("_a") + F.lit(share) * effect / F.col("s0")).alias("_a")), beta)

        search = Newton(evaluate, own, y, n, positives / n, 4 * begun[0], begun)
        beta_of = lambda: search.beta.copy()
        # Effects have steps of their own, so the search goes on until the groups' residuals vanish too.
        for _ in range(max_iter):
            search.run(max_iter, tol)
            if state["own"] <= max(tol * n, 1e-7):
                break
            search.hess, search.grad, search.ll = evaluate(search.beta, 1.0)
        else:
            raise NotConverged(f"logit of {y}: the group effects did not converge")
        cov, groups = _sandwich(state["table"], k, 3 + k, search.hess, int(n), k + state["groups"], small_sample)
        stats = logit_stats(search.ll, n, positives, k + groups, float(np.abs(search.grad).max(initial=0)))
        return Fit(own, search.beta, cov, int(n), groups, stats, gone)
    finally:
        for d in held:
            d.unpersist()
