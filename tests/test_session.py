from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stayrate.operators.joins import broadcast_if_small, hot_keys, salted_join
from stayrate.operators.preprocess import prepare_predictors
from stayrate.session import release_staged, report, shared_dir, stage, staging, work_path


def test_staged_results_live_under_the_shared_folder(spark):
    df = stage(spark.range(5), "numbers")
    path = df.inputFiles()[0]
    assert shared_dir(spark).split(":")[-1] in path and spark.sparkContext.applicationId in path
    assert df.count() == 5 and work_path(spark, "x") != work_path(spark, "x")
    assert release_staged(spark)
    with pytest.raises(Exception, match="(?i)not.exist|no such file|path"):
        spark.read.parquet(path).count()


def test_hot_keys_are_few_and_salted_joins_keep_every_row(spark):
    """One key holds two thirds of the rows; one key has no match, one is missing."""
    rows = [("hot", i) for i in range(2000)] + [(f"k{i % 50}", i) for i in range(900)]
    rows += [("lonely", 1), (None, 2)]
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("other", 9)] + [(f"k{i}", i) for i in range(50)], "k string, w int")
    assert [r.k for r in hot_keys(left, "k", 0.1, 0).collect()] == ["hot"]
    assert hot_keys(left, "k", 0.1, 5000).count() == 0
    salted = salted_join(left, right, "k", salts=8, share=0.1, min_rows=0)
    plain = left.join(right, "k")
    assert salted.count() == 2900
    assert salted.select("k", "v", "w").exceptAll(plain.select("k", "v", "w")).count() == 0
    assert "Cartesian" not in salted._jdf.queryExecution().executedPlan().toString()


def test_broadcast_needs_a_checked_size(spark):
    def hinted(df):
        return "hint" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(broadcast_if_small(spark.range(10), limit=10))
    assert not hinted(broadcast_if_small(spark.range(11), limit=10))
    assert not hinted(broadcast_if_small(spark.range(1), limit=10, rows=11))


def test_prepared_predictors(spark):
    df = spark.createDataFrame([(float("inf"), 3, None), (1.5, None, "x")], "a double, b int, c string")
    got = prepare_predictors(df, ["a", "b"], ["c"]).orderBy(F.col("a").desc_nulls_last()).collect()
    assert [tuple(r) for r in got] == [(1.5, None, "x"), (None, 3.0, "__MISSING__")]


def test_nothing_staged_is_left_after_a_flow(spark):
    with staging(spark):
        path = stage(spark.range(5), "inside").inputFiles()[0]
        rows = report(stage(spark.range(3), "more"))
    assert rows.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|no such file|path"):
        spark.read.parquet(path).count()
    with pytest.raises(RuntimeError), staging(spark):
        failed = stage(spark.range(5), "failed").inputFiles()[0]
        raise RuntimeError
    with pytest.raises(Exception, match="(?i)not.exist|no such file|path"):
        spark.read.parquet(failed).count()
