"""Monthly partials of an activity log, kept up to date by each batch that arrives.

A partial is one row per entity and month of one batch: the days with activity as bits of a
mask, and the sums of the measures. Both combine: masks by OR, sums by addition. So a new
log part costs its own rows, features are made from the partials alone, and the log is never
scanned again. A batch overwrites exactly its own folders, so a batch that is retried counts
once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.operators.windows import Period
from stayrate.streaming.ingest import stream_source


def month_partials(logs: DataFrame, id_col: str, day: str, sums: Mapping[str, Column | str]) -> DataFrame:
    """One row per entity and month: ``log_month``, ``days`` (bit d - 1 for day d) and sums.

    Rows without a day belong to no month and are left out. One grouping: masks and sums are
    combined before the exchange.
    """
    measures = {n: F.col(e) if isinstance(e, str) else e for n, e in sums.items()}
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth("_day") - 1)
    return (
        logs.select(id_col, F.to_date(day).alias("_day"), *[e.alias(n) for n, e in measures.items()])
        .where(F.col("_day").isNotNull())
        .groupBy(id_col, F.date_format("_day", "yyyy-MM").alias("log_month"))
        .agg(F.bit_or(bit).alias("days"), *[F.sum(n).alias(n) for n in measures])
    )


def ingest_partials(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    parse: Callable[[DataFrame], DataFrame],
    id_col: str,
    day: str,
    sums: Mapping[str, Column | str],
    files_per_trigger: int | None = None,
) -> None:
    """Take in the log files that arrived since the last run, then stop.

    ``parse`` types the raw rows. Each batch writes one folder per month and batch, and
    overwrites only those, also when it runs again after a failure.
    """

    def store(batch: DataFrame, number: int) -> None:
        partials = month_partials(parse(batch), id_col, day, sums).withColumn("batch", F.lit(number))
        (
            partials.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .partitionBy("log_month", "batch")
            .parquet(target)
        )

    query = (
        stream_source(spark, source, schema, files_per_trigger)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _months(period: Period) -> list[str]:
    """The months a period consists of; a period that cuts a month is refused."""
    if period.start.day != 1 or period.end.day != 1:
        raise ValueError(f"{period.suffix}: partials answer for whole months only")
    months, at = [], period.start
    while at < period.end:
        months.append(f"{at:%Y-%m}")
        at = date(at.year + at.month // 12, at.month % 12 + 1, 1)
    return months


def totals_from_partials(
    partials: DataFrame,
    id_col: str,
    measures: Sequence[str],
    periods: Sequence[Period],
    active_name: str = "active_days",
) -> DataFrame:
    """What ``operators.windows.period_totals`` returns, from partials of all batches.

    Only the month folders of the periods are read, and only their entities and sums.
    """
    months = {p.suffix: _months(p) for p in periods}
    wanted = sorted({m for names in months.values() for m in names})
    month = F.col("log_month").cast("string")
    outputs = []
    for p in periods:
        days = [F.coalesce(F.bit_count(F.bit_or(F.when(month == m, F.col("days")))), F.lit(0)).cast("bigint") for m in months[p.suffix]]
        outputs.append(reduce(lambda a, b: a + b, days).alias(f"{active_name}_{p.suffix}"))
        inside = month.isin(months[p.suffix])
        outputs += [F.sum(F.when(inside, F.col(n))).alias(f"{n}_{p.suffix}") for n in measures]
    return partials.where(month.isin(wanted)).groupBy(id_col).agg(*outputs)
