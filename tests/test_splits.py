from __future__ import annotations

import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stayrate.errors import DataQualityError
from stayrate.operators import splits as S


def test_recorded_sizes():
    """992,931 rows with 63,471 positives: the recorded class sizes of each part."""
    sizes = S.split_sizes({0: 929460, 1: 63471})
    assert [sum(v) for v in zip(*sizes.values())] == [695051, 148940, 148940]
    assert sizes[1] == (44430, 9521, 9520)


@pytest.mark.parametrize("counts", [{0: 7, 1: 3}, {0: 1, 1: 1}, {0: 100}, {0: 333, 1: 333, 2: 334}])
def test_sizes_add_up(counts):
    assert {k: sum(v) for k, v in S.split_sizes(counts).items()} == counts


@pytest.mark.parametrize("digits", [1, 3])
def test_split_is_the_hash_order_cut(spark, digits):
    rows = [(f"u{i}", int(i % 10 == 0)) for i in range(1234)]
    df = spark.createDataFrame(rows, "id string, y int")
    got = {r.id: r.split for r in S.stratified_split(df, "id", "y", 42, digits=digits).collect()}
    sizes = S.split_sizes({0: sum(y == 0 for _, y in rows), 1: sum(y for _, y in rows)})
    for label, (train, validation, test) in sizes.items():
        ids = [i for i, y in rows if y == label]
        ids.sort(key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
        wanted = ["train"] * train + ["validation"] * validation + ["test"] * test
        assert [got[i] for i in ids] == wanted
    assert len(got) == len(rows)


def test_split_checks(spark):
    df = spark.createDataFrame([(f"u{i}", i % 2) for i in range(40)], "id string, y int")
    good = S.stratified_split(df, "id", "y").persist()
    S.check_split(good, df, "id")
    for bad in (good.unionByName(good.limit(1)), good.where("id != 'u1'"), good.where("split != 'test'")):
        with pytest.raises(DataQualityError):
            S.check_split(bad, df, "id")
    with pytest.raises(DataQualityError):
        S.stratified_split(spark.createDataFrame([("a", None), ("b", 1)], "id string, y int"), "id", "y")
    good.unpersist()


def test_chronological(spark):
    days = [datetime(2025, 9, 30), datetime(2025, 10, 31), datetime(2026, 2, 28), datetime(2026, 6, 30)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d timestamp_ntz")
    ranges = {
        "train": (None, date(2025, 9, 30)),
        "validation": (date(2025, 10, 1), date(2026, 1, 31)),
        "test": (date(2026, 2, 1), date(2026, 5, 31)),
    }
    split = S.chronological_split(df, "d", ranges)
    assert [r.split for r in split.orderBy("i").collect()] == ["train", "validation", "test", None]


def test_summary(spark):
    rows = [("train", "a", 1), ("train", "a", 0), ("train", "b", 0), ("test", "a", 1)]
    df = spark.createDataFrame(rows, "split string, id string, y int")
    got = {r.split: (r.rows, r.entities, r.positives, r.prevalence_pct) for r in S.split_summary(df, "split", "id", "y").collect()}
    assert got == {"train": (3, 2, 1, pytest.approx(100 / 3)), "test": (1, 1, 1, 100.0)}
    wide = {r.y: (r.train, r.validation, r.test) for r in S.label_counts_by_split(df, "split", "y").collect()}
    assert wide == {0: (2, 0, 0), 1: (1, 0, 1)}


def test_no_task_holds_a_whole_class(spark):
    df = spark.range(2000).select("id", F.lit(0).alias("y"))
    plan = S.stratified_split(df, "id", "y")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert windows and all("_bucket" in line for line in windows)
