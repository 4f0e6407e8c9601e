import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import SEED
from tidemark.operators import order_stats as os_
from tidemark.operators.describe import descriptives, spearman
from tidemark.operators.skew import hot_keys, lookup_join, running_before


def test_running_before_over_a_group_larger_than_a_range(spark):
    rng = random.Random(1)
    rows = [("big", i, rng.randrange(5), 1.0) for i in range(900)] + [(f"g{k}", i, k, 1.0) for k in range(30) for i in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int, w double").repartition(5)
    found = {(r["g"], r["o"]): (r["before_v"], r["before_w"]) for r in running_before(df, ["o"], ["v", "w"], ["g"], parts=7).collect()}
    want, total = {}, {}
    for g, o, v, w in sorted(rows):
        s = total.get(g, (0, 0.0))
        want[g, o] = s
        total[g] = (s[0] + v, s[1] + w)
    assert found == want


def test_running_before_without_groups(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "o int, v int")
    found = {r["o"]: r["before_v"] for r in running_before(df, ["o"], ["v"], parts=6).collect()}
    assert found == {i: sum(k % 3 for k in range(i)) for i in range(500)}


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0, 2.0], list(range(101)), [0.5] * 50 + [float(i) for i in range(40)]])
def test_quantiles_equal_linear_interpolation(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    assert os_.quantile_values(df, ["x"], probs)["x"] == pytest.approx(list(np.quantile(values, probs)))


def test_quantile_bins_keep_ties_together(spark):
    values = [0.0] * 40 + [1.0] * 30 + [float(i) for i in range(2, 32)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    edges = sorted(set(np.quantile(values, [k / 5 for k in range(6)])))
    want = {v: max(0, int(np.searchsorted(edges, v, side="left")) - 1) for v in set(values)}
    assert {(r["x"], r["bin"]) for r in os_.quantile_bins(df, "x", 5).collect()} == {(v, b) for v, b in want.items()}


def test_constant_column_has_one_bin(spark):
    df = spark.createDataFrame([(1.0,)] * 9, "x double")
    assert {r["bin"] for r in os_.quantile_bins(df, "x", 4).collect()} == {0}


def test_hash_sample_takes_the_smallest_hashes(spark):
    ids = list(range(1, 4000, 3))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = sorted(ids, key=lambda i: ((i + SEED) * 2654435761 % 2 ** 32, i))
    for n in (1, 100, len(ids), len(ids) + 5):
        assert {r["id"] for r in os_.hash_sample(df, "id", n).collect()} == set(want[:n])


def test_lookup_join_beyond_the_broadcast_size(spark):
    rng = random.Random(2)
    fact = spark.createDataFrame([(0 if i % 3 == 0 else rng.randrange(1, 50), i) for i in range(600)], "k int, id int")
    table = spark.createDataFrame([(k, k * 10) for k in range(40)], "k int, v int")
    want = sorted((r["id"], r["v"]) for r in lookup_join(fact, table, ["k"]).collect() if r["v"] is not None)
    for hot_rows in (100, 10 ** 9):
        far = lookup_join(fact, table, ["k"], broadcast_rows=5, salts=7, hot_rows=hot_rows)
        assert far.count() == 600
        assert sorted((r["id"], r["v"]) for r in far.collect() if r["v"] is not None) == want


def test_hot_keys_are_those_with_a_large_share(spark):
    df = spark.createDataFrame([(0,)] * 300 + [(i,) for i in range(1, 600)], "k int")
    assert [r["k"] for r in hot_keys(df, ["k"], share=0.1, min_rows=50).collect()] == [0]
    assert hot_keys(df, ["k"], min_rows=1000) is None


def test_descriptives_and_spearman(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, 200), rng.normal(size=200)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y)], "x int, y double")
    rows = {r["variable"]: r for r in descriptives(df, {"x": "x", "y": "y"}).collect()}
    assert rows["y"]["mean"] == round(y.mean(), 4) and rows["y"]["sd"] == round(y.std(ddof=1), 4)
    assert rows["x"]["p75"] == round(float(np.quantile(x, .75)), 3)

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    want = round(float(np.corrcoef(ranks(x), ranks(y))[0, 1]), 3)
    found = {(r["row"], r["col"]): r["rho"] for r in spearman(df, {"x": "x", "y": "y"}).collect()}
    assert found["x", "y"] == found["y", "x"] == want and found["x", "x"] == 1.0
