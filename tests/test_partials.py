"""Monthly partials: two runs equal one scan of the whole log, and a batch counts once."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from stayrate.functions.cleaning import parse_yyyymmdd
from stayrate.operators.windows import Period, period_totals
from stayrate.streaming import partials as P

SCHEMA = "id string, day string, n long, secs double"
PERIODS = (Period("M1", date(2024, 2, 1), date(2024, 3, 1)), Period("Q", date(2023, 12, 1), date(2024, 3, 1)))


def parse(df):
    return df.withColumn("day", parse_yyyymmdd("day"))


def log(seed, rows=600):
    rng = random.Random(seed)
    first = date(2023, 11, 1)
    days = [first + timedelta(days=rng.randrange(150)) for _ in range(rows)]
    return [(rng.choice(["a", "b", "c", "hot", "hot"]), f"{d:%Y%m%d}" if rng.random() < 0.95 else "20240230", rng.randrange(9), rng.randrange(100) / 4) for d in days]


def totals(df):
    return period_totals(parse(df), "id", "day", {"n": "n", "secs": "secs"}, PERIODS)


def test_two_runs_equal_one_scan(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    source, target, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    schema, every = _parse_datatype_string(SCHEMA), []
    for run in range(2):
        rows = log(run)
        every += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(source)
        P.ingest_partials(spark, source, target, checkpoint, schema, parse, "id", "day", {"n": "n", "secs": "secs"})
        stored = spark.read.parquet(target)
        found = P.totals_from_partials(stored, "id", ["n", "secs"], PERIODS)
        assert rows_of(found, "id") == rows_of(totals(spark.createDataFrame(every, SCHEMA)).select(*found.columns), "id")
    assert {r["batch"] for r in stored.select("batch").distinct().collect()} == {0, 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cast(log_month" in plan or "PartitionFilters: [log_month" in plan
    before = rows_of(found, "id")
    P.ingest_partials(spark, source, target, checkpoint, schema, parse, "id", "day", {"n": "n", "secs": "secs"})
    assert rows_of(P.totals_from_partials(spark.read.parquet(target), "id", ["n", "secs"], PERIODS), "id") == before


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """The same batch written twice leaves one partial, and the other batch's as it was."""
    first, second = (spark.createDataFrame(log(seed), SCHEMA) for seed in (5, 6))
    for number, df in ((0, first), (1, second), (0, first)):
        part = P.month_partials(parse(df), "id", "day", {"n": "n", "secs": "secs"}).withColumn("batch", F.lit(number))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_month", "batch").parquet(f"{tmp_path}/p")
    found = P.totals_from_partials(spark.read.parquet(f"{tmp_path}/p"), "id", ["n", "secs"], PERIODS)
    assert rows_of(found, "id") == rows_of(totals(first.unionByName(second)).select(*found.columns), "id")


def test_a_period_that_cuts_a_month_is_refused(spark):
    empty = spark.createDataFrame([], "id string, log_month string, days long, n long")
    with pytest.raises(ValueError):
        P.totals_from_partials(empty, "id", ["n"], [Period("x", date(2024, 1, 2), date(2024, 2, 1))])
