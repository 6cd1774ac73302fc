from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from stayrate.operators.windows import (
    Period,
    TransactionColumns,
    period_features,
    period_totals,
    transaction_features,
    transaction_totals,
)

PERIODS = (Period("M1", date(2024, 2, 1), date(2024, 3, 1)), Period("M2", date(2024, 1, 1), date(2024, 2, 1)))


def test_window_edges(spark):
    logs = spark.createDataFrame(
        [
            ("a", date(2024, 1, 31), 1.0, 1),
            ("a", date(2024, 2, 1), 2.0, 2),
            ("a", date(2024, 2, 1), 4.0, None),
            ("a", date(2024, 2, 29), None, 8),
            ("a", date(2024, 3, 1), 99.0, 99),
            ("a", date(2023, 12, 31), 99.0, 99),
            ("a", None, 99.0, 99),
            ("b", date(2024, 1, 1), None, None),
        ],
        "id string, day date, secs double, n int",
    )
    cohort = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "id string, y int")
    totals = period_totals(logs, "id", "day", {"secs": "secs", "n": "n"}, PERIODS)
    features = period_features(cohort, totals, "id", PERIODS, ["secs", "n"], "secs", "avg")
    assert features.columns == [
        "id", "y", "active_days_M1", "secs_M1", "n_M1", "active_days_M2", "secs_M2", "n_M2", "avg_M1", "avg_M2",
    ]
    assert rows_of(features, "id") == [
        ("a", 1, 2, 6.0, 10, 1, 1.0, 1, 3.0, 1.0),
        # a day with no measure counts as active, its sum is unknown, so no average
        ("b", 0, 0, 0.0, 0, 1, 0.0, 0, None, None),
        ("c", 0, 0, 0.0, 0, 0, 0.0, 0, None, None),
    ]


def test_instants_near_midnight(spark):
    logs = spark.createDataFrame(
        [
            ("a", datetime(2024, 2, 29, 23, 59, 59, 999999), 1.0),
            ("a", datetime(2024, 3, 1), 50.0),
            ("a", datetime(2024, 1, 31, 23, 59, 59, 999999), 7.0),
        ],
        "id string, ts timestamp_ntz, v double",
    )
    row = period_totals(logs, "id", "ts", {"v": "v"}, PERIODS).first()
    assert (row.active_days_M1, row.v_M1, row.active_days_M2, row.v_M2) == (1, 1.0, 1, 7.0)


def test_hot_entity_plan_counts_days_without_expand(spark):
    logs = spark.range(100).select(
        F.lit("hot").alias("id"), F.expr("date_add(date'2024-01-01', int(id % 60))").alias("day"), F.lit(1.0).alias("v")
    )
    totals = period_totals(logs, "id", "day", {"v": "v"}, PERIODS)
    assert "Expand" not in totals._jdf.queryExecution().executedPlan().toString()
    row = totals.first()
    assert (row.active_days_M1, row.active_days_M2, row.v_M1 + row.v_M2) == (29, 31, 100.0)


def test_transactions(spark):
    names = TransactionColumns("id", "day", "paid", "listed", "days", "renew", "cancel", "expiry")
    day = date(2024, 1, 10)
    facts = spark.createDataFrame(
        [
            ("a", day, 10.0, 12.0, 30, 1, 0, date(2024, 2, 1)),
            ("a", day + timedelta(1), None, 12.0, None, None, 1, date(1970, 1, 1)),
            ("a", date(2023, 1, 1), 99.0, 99.0, 99, 1, 1, day),
        ],
        "id string, day date, paid double, listed double, days int, renew int, cancel int, expiry date",
    )
    cohort = spark.createDataFrame([("a", 1), ("b", 0)], "id string, y int")
    totals = transaction_totals(facts, names, date(2024, 1, 1), date(2024, 1, 31), date(2000, 1, 1))
    assert rows_of(transaction_features(cohort, totals, "id"), "id") == [
        ("a", 1, 2, 10.0, 10.0, 24.0, 30.0, 0.5, 0.5, 20, 1),
        ("b", 0, 0, 0.0, None, 0.0, None, None, None, None, 0),
    ]
    assert transaction_features(cohort, totals, "id").schema["transaction_recency_days"].dataType.simpleString() == "int"


@pytest.mark.parametrize("limit", [10, 1])
def test_outsiders_never_change_the_result(spark, limit):
    from stayrate.operators.joins import drop_outsiders

    facts = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "id string, v int")
    keys = spark.createDataFrame([("a",), ("b",)], "id string")
    kept = drop_outsiders(facts, keys, "id", limit=limit)
    assert rows_of(kept.join(keys, "id", "right")) == [("a", 1), ("b", 2)]


def test_days_of_long_and_overlapping_periods(spark):
    """Masks of several words; every day once, however many rows it has."""
    import random

    rng = random.Random(3)
    first = date(2023, 1, 1)
    rows = [(rng.choice("ab"), first + timedelta(days=rng.randrange(400)), 1.0) for _ in range(900)]
    rows += [("c", first, 1.0)] * 50 + [("c", date(2023, 12, 31), 1.0)]
    periods = (
        Period("year", first, date(2024, 1, 1)), Period("spring", date(2023, 3, 1), date(2023, 6, 1)),
        Period("day", date(2023, 12, 31), date(2024, 1, 1)), Period("weeks", date(2023, 1, 1), date(2023, 3, 6)),
    )
    totals = period_totals(spark.createDataFrame(rows, "id string, day date, v double"), "id", "day", {"v": "v"}, periods)
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for r in totals.collect():
        for p in periods:
            wanted = {d for i, d, _ in rows if i == r["id"] and p.start <= d < p.end}
            assert r[f"active_days_{p.suffix}"] == len(wanted)
