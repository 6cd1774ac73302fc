"""Running totals, ranks and quantiles, with buckets forced to be tiny."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.operators.ordering import (
    exact_medians,
    exact_quantiles,
    hash_rank,
    running_totals,
)


@pytest.fixture(scope="module")
def skewed():
    """One group holds two thirds of the rows, one is NULL; values tie often."""
    rng = np.random.default_rng(1)
    groups = rng.choice(["hot", "cold", None], 3000, p=[0.67, 0.23, 0.10])
    values = np.round(rng.exponential(1.0, 3000), 2)
    return [(i, None if g is None else str(g), float(v)) for i, (g, v) in enumerate(zip(groups, values))]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("per_bucket", [40, 10_000])
def test_running_totals(spark, skewed, descending, per_bucket):
    df = spark.createDataFrame(skewed, "i int, g string, v double")
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))
    got = running_totals(counted, "v", ["n", "s"], ["g"], descending, rows_per_bucket=per_bucket).collect()
    expected = {}
    for g in ("hot", "cold", None):
        mine = [(v, i) for i, h, v in skewed if h == g]
        for v in {v for v, _ in mine}:
            reached = [(w, i) for w, i in mine if (w >= v if descending else w <= v)]
            expected[(g, v)] = (len(reached), sum(i for _, i in reached), len(mine), sum(i for _, i in mine))
    assert {(r.g, r.v): (r.cum_n, r.cum_s, r.all_n, r.all_s) for r in got} == expected
    assert len(got) == len(expected)


def test_running_totals_without_group(spark):
    df = spark.createDataFrame([(float(v), 1) for v in range(500)], "v double, n int")
    got = {r.v: (r.cum_n, r.all_n) for r in running_totals(df, "v", ["n"], rows_per_bucket=30).collect()}
    assert got == {float(v): (v + 1, 500) for v in range(500)}


def test_hash_rank_is_the_seeded_order(spark, skewed):
    df = spark.createDataFrame(skewed, "i int, g string, v double")
    got = {(r.g, r.i): r.r for r in hash_rank(df, "i", 5, ["g"], name="r", digits=2).collect()}
    for g in ("hot", "cold", None):
        ids = [i for i, h, _ in skewed if h == g]
        ordered = sorted(ids, key=lambda i: hashlib.md5(f"{i}|5".encode()).hexdigest())
        assert [got[(g, i)] for i in ordered] == list(range(len(ids)))


@pytest.mark.parametrize("per_bucket", [25, 10_000])
def test_quantiles_match_numpy(spark, skewed, per_bucket):
    df = spark.createDataFrame(skewed, "i int, g string, v double")
    probabilities = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.975, "e": 1.0}
    for r in exact_quantiles(df, "v", probabilities, ["g"], per_bucket).collect():
        mine = [v for _, h, v in skewed if h == r.g]
        assert [r[k] for k in probabilities] == pytest.approx(np.quantile(mine, list(probabilities.values())))


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_medians_match_numpy(spark, accuracy):
    rng = np.random.default_rng(2)
    rows = [
        (float(a), float(b), None if i % 3 else float(i), None, 7.0)
        for i, (a, b) in enumerate(zip(rng.normal(size=1001), rng.integers(0, 5, 1001)))
    ]
    rows.append((float("nan"), 2.0, 1.0, None, 7.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = exact_medians(df, ["a", "b", "c", "d", "e"], accuracy=accuracy, rows_per_bucket=50)
    assert got["a"] == np.median([r[0] for r in rows[:-1]])
    assert got["b"] == np.median([r[1] for r in rows])
    assert got["c"] == np.median([r[2] for r in rows if r[2] is not None])
    assert got["d"] is None and got["e"] == 7.0


def test_median_of_an_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert exact_medians(df, ["v"]) == {"v": 2.5}
