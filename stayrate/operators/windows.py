"""Per-entity aggregates over fixed date windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.calendar import days_to
from stayrate.functions.cleaning import in_half_open, safe_ratio, zero_if_null


@dataclass(frozen=True)
class Period:
    """Half-open date window ``[start, end)`` with a suffix for its columns."""

    suffix: str
    start: date
    end: date


def date_coverage(df: DataFrame, date_cols: Sequence[str], window_col: str, first: date, last: date) -> DataFrame:
    """One row: total rows, rows without each date, rows inside the closed window."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"invalid_{c}") for c in date_cols],
        F.count_if(F.col(window_col).between(F.lit(first), F.lit(last))).alias("rows_in_window"),
    )


def period_totals(
    df: DataFrame,
    id_col: str,
    day: str,
    sums: Mapping[str, Column | str],
    periods: Sequence[Period],
    active_name: str = "active_days",
) -> DataFrame:
    """Distinct active days and sums per entity and period, one row per entity.

    The days of a period are bits of a mask: masks are combined before the exchange like
    the sums, so one grouping counts days without a DISTINCT and without a second exchange,
    and an entity holding a large share of the log is one row from each task.
    """
    first, last = min(p.start for p in periods), max(p.end for p in periods)
    measures = {n: F.col(e) if isinstance(e, str) else e for n, e in sums.items()}
    days = df.where(in_half_open(day, F.lit(first), F.lit(last))).select(
        id_col, F.to_date(day).alias("_day"), *[e.alias(n) for n, e in measures.items()]
    )
    outputs = []
    for p in periods:
        outputs.append(active_days("_day", p).alias(f"{active_name}_{p.suffix}"))
        inside = in_half_open("_day", F.lit(p.start), F.lit(p.end))
        outputs.extend(F.sum(F.when(inside, F.col(n))).alias(f"{n}_{p.suffix}") for n in measures)
    return days.groupBy(id_col).agg(*outputs)


def active_days(day: str, period: Period) -> Column:
    """Aggregate: number of distinct days of the period, by masks of 64 days each."""
    offset = F.date_diff(F.col(day), F.lit(period.start))
    words = -(-(period.end - period.start).days // 64)
    counts = []
    for word in range(words):
        inside = in_half_open(day, F.lit(period.start), F.lit(period.end)) & offset.between(64 * word, 64 * word + 63)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (offset - 64 * word).cast("int"))
        counts.append(F.coalesce(F.bit_count(F.bit_or(F.when(inside, bit))), F.lit(0)).cast("bigint"))
    return reduce(lambda x, y: x + y, counts, F.lit(0).cast("bigint"))


def period_features(
    cohort: DataFrame,
    totals: DataFrame,
    id_col: str,
    periods: Sequence[Period],
    sums: Sequence[str],
    average_of: str,
    average_name: str,
    active_name: str = "active_days",
) -> DataFrame:
    """Cohort LEFT JOIN period totals: counts and sums 0 when absent, averages NULL."""
    joined = cohort.join(totals, id_col, "left")
    types = dict(totals.dtypes)
    filled = [
        zero_if_null(c, types[c]).alias(c)
        for p in periods
        for c in [f"{active_name}_{p.suffix}", *[f"{n}_{p.suffix}" for n in sums]]
    ]
    averages = [
        safe_ratio(f"{average_of}_{p.suffix}", f"{active_name}_{p.suffix}").alias(
            f"{average_name}_{p.suffix}"
        )
        for p in periods
    ]
    return joined.select(*cohort.columns, *filled, *averages)


def rate_of(value: Column | str, target=1) -> Column:
    """Share of rows equal to ``target``; NULL counts as not equal."""
    column = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(column == target, 1.0).otherwise(0.0))


@dataclass(frozen=True)
class TransactionColumns:
    """Names of the transaction table's columns."""

    id: str
    date: str
    paid: str
    list_price: str
    plan_days: str
    auto_renew: str
    cancel: str
    expiry: str


def transaction_totals(
    df: DataFrame, columns: TransactionColumns, first: date, last: date, earliest_expiry: date
) -> DataFrame:
    """One row per entity over the closed window ``first..last``."""
    c = columns
    inside = df.where(F.col(c.date).between(F.lit(first), F.lit(last)))
    return inside.groupBy(c.id).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(c.paid).alias("total_amount_paid"),
        F.avg(c.paid).alias("avg_amount_paid"),
        F.sum(c.list_price).alias("total_plan_list_price"),
        F.avg(c.plan_days).alias("avg_payment_plan_days"),
        rate_of(c.auto_renew).alias("auto_renew_rate"),
        rate_of(c.cancel).alias("cancellation_rate"),
        days_to(F.max(c.date), last).alias("transaction_recency_days"),
        F.count_if(F.col(c.expiry) >= F.lit(earliest_expiry)).alias("valid_expiry_count"),
    )


def transaction_features(cohort: DataFrame, totals: DataFrame, id_col: str) -> DataFrame:
    """Cohort LEFT JOIN transaction totals: counts and sums 0, averages and rates NULL."""
    joined = cohort.join(totals, id_col, "left")
    return joined.select(
        *cohort.columns,
        zero_if_null("transaction_count", "bigint").alias("transaction_count"),
        zero_if_null("total_amount_paid", "double").alias("total_amount_paid"),
        "avg_amount_paid",
        zero_if_null("total_plan_list_price", "double").alias("total_plan_list_price"),
        "avg_payment_plan_days",
        "auto_renew_rate",
        "cancellation_rate",
        "transaction_recency_days",
        zero_if_null("valid_expiry_count", "bigint").alias("valid_expiry_count"),
    )
