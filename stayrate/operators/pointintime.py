"""Point-in-time panels: entities by index date, without looking ahead.

Events meet index dates through a bounded explode (see ``IndexCalendar``), so
every event table is read once, joins are equalities on (entity, index date),
and all of them share that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.calendar import IndexCalendar, elapsed_days, plus_days
from stayrate.functions.cleaning import is_observed, zero_if_null

INDEX = "index_date"


def spine(population: DataFrame, calendar: IndexCalendar, acquired: str) -> DataFrame:
    """Population by every index date at or after acquisition; none without a date."""
    return calendar.from_instant(population, acquired, INDEX)


def ineligible_keys(
    outcomes: DataFrame,
    calendar: IndexCalendar,
    id_col: str,
    cancelled: str,
    is_final: Column,
    is_pending: Column,
    returned: str,
) -> DataFrame:
    """(entity, index date) pairs to drop.

    A final cancellation rules an entity out from its date on. A pending one
    does so until the return date, forever when there is none. Other
    cancellations do not count.
    """
    marked = outcomes.select(
        id_col,
        F.col(cancelled).alias("_from"),
        F.col(returned).alias("_returned"),
        F.coalesce(is_final, F.lit(False)).alias("_final"),
        F.coalesce(is_pending, F.lit(False)).alias("_pending"),
    ).where(F.col("_final") | F.col("_pending"))
    due = calendar.from_instant(marked, "_from", INDEX)
    away = F.col("_returned").isNull() | (F.col("_returned") > F.col(INDEX))
    return due.where(F.col("_final") | away).select(id_col, INDEX).distinct()


def eligible_spine(spine_rows: DataFrame, ineligible: DataFrame, id_col: str) -> DataFrame:
    return spine_rows.join(ineligible, [id_col, INDEX], "left_anti")


def add_ages(df: DataFrame, ages: Mapping[str, str]) -> DataFrame:
    """Fractional days from each date column to the index date; may be negative."""
    return df.withColumns({name: elapsed_days(INDEX, c) for name, c in ages.items()})


def lookback_features(
    events: DataFrame,
    calendar: IndexCalendar,
    id_col: str,
    ts: str,
    days: int,
    aggregates: Sequence[Column],
    recency: str,
) -> DataFrame:
    """Aggregates over ``(index - days, index]`` and days since the last event."""
    spread = calendar.with_lookback(events, ts, days, INDEX)
    summed = spread.groupBy(id_col, INDEX).agg(*aggregates, F.max(ts).alias("_last"))
    return summed.withColumn(recency, elapsed_days(INDEX, "_last")).drop("_last")


def total_or_zero(value: Column | str) -> Column:
    """Sum that is 0 when a group's values are all missing."""
    return zero_if_null(F.sum(value))


def horizon_labels(
    outcomes: DataFrame, calendar: IndexCalendar, id_col: str, ts: str, days: int, qualifies: Column
) -> DataFrame:
    """Distinct (entity, index date) pairs with a qualifying event in ``(index, index + days]``."""
    spread = calendar.with_horizon(outcomes.where(qualifies), ts, days, INDEX)
    return spread.select(id_col, INDEX).distinct()


def assemble(
    spine_rows: DataFrame,
    features: Sequence[DataFrame],
    positives: DataFrame,
    id_col: str,
    target: str,
    horizon: int,
    observed: Mapping[str, str],
) -> DataFrame:
    """Spine LEFT JOIN features and label; counts stay NULL, presence flags are added."""
    panel = spine_rows
    for table in features:
        panel = panel.join(table, [id_col, INDEX], "left")
    panel = panel.join(positives.withColumn("_positive", F.lit(1)), [id_col, INDEX], "left")
    return panel.withColumns(
        {
            target: is_observed("_positive"),
            "label_window_end": plus_days(INDEX, horizon),
            **{name: is_observed(c) for name, c in observed.items()},
        }
    ).drop("_positive")


def prevalence_by_date(panel: DataFrame, target: str) -> DataFrame:
    """Rows, positives and their share per index date."""
    return panel.groupBy(INDEX).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(target).alias("positives"),
        F.avg(target).alias("prevalence"),
    )


def last_dates(by_date: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` latest index dates."""
    return by_date.orderBy(F.col(INDEX).desc()).limit(n)
