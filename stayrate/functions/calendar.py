"""Date arithmetic without time zones, and the month-end index calendar."""

from __future__ import annotations

import math
from calendar import monthrange
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.cleaning import as_column

MICROS_PER_DAY = 86_400_000_000
SHORTEST_MONTH_DAYS = 28


def micros_of_day(ts: Column) -> Column:
    """Microseconds since midnight, without touching the session time zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return seconds.cast("bigint") * 1_000_000 + fraction


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days from ``earlier`` to ``later`` (negative when reversed)."""
    end = as_column(later).cast("timestamp_ntz")
    start = as_column(earlier).cast("timestamp_ntz")
    whole = F.datediff(end, start).cast("bigint") * MICROS_PER_DAY
    micros = whole + micros_of_day(end) - micros_of_day(start)
    return micros.cast("double") / F.lit(float(MICROS_PER_DAY))


def days_to(value: Column | str, end: date) -> Column:
    """Whole days from the value to a fixed date."""
    return F.datediff(F.lit(end), as_column(value))


def plus_days(value: Column | str, days: int) -> Column:
    return as_column(value) + F.expr(f"INTERVAL {int(days)} DAYS")


def minus_days(value: Column | str, days: int) -> Column:
    return as_column(value) - F.expr(f"INTERVAL {int(days)} DAYS")


@dataclass(frozen=True)
class IndexCalendar:
    """Month-ends from ``first`` to ``last``; each stands for midnight at the day's start."""

    first: date
    last: date

    def _literal(self, day: date) -> Column:
        return F.lit(day.isoformat()).cast("timestamp_ntz")

    @property
    def start(self) -> Column:
        return self._literal(self.first)

    @property
    def end(self) -> Column:
        return self._literal(self.last)

    def days(self) -> list[date]:
        """The index dates."""
        found = []
        year, month = self.first.year, self.first.month
        while (year, month) <= (self.last.year, self.last.month):
            found.append(date(year, month, monthrange(year, month)[1]))
            year, month = (year, month + 1) if month < 12 else (year + 1, 1)
        return [d for d in found if self.first <= d <= self.last]

    def dates(self) -> Column:
        """All index instants as one constant array."""
        return F.array(*[self._literal(d) for d in self.days()])

    def near(self, ts: Column, months_before: int, months_after: int) -> Column:
        """Month-ends around an event, one per offset, as an array column."""
        offsets = range(-months_before, months_after + 1)
        return F.array(
            *[F.last_day(F.add_months(ts, k)).cast("timestamp_ntz") for k in offsets]
        )

    def with_lookback(self, df: DataFrame, ts: str, days: int, name: str = "index_date") -> DataFrame:
        """Each event once per index date with ``ts`` in ``(date - days, date]``.

        The interval condition becomes a bounded explode: an event can only
        fall in the windows of the next few month-ends, so no range join is
        needed and the result groups on plain equality.
        """
        reach = math.ceil(days / SHORTEST_MONTH_DAYS)
        column = F.col(ts)
        scanned = df.where((column > minus_days(self.start, days)) & (column <= self.end))
        spread = scanned.withColumn(name, F.explode(self.near(column, 0, reach)))
        return spread.where(
            F.col(name).between(self.start, self.end)
            & (column <= F.col(name))
            & (column > minus_days(name, days))
        )

    def with_horizon(self, df: DataFrame, ts: str, days: int, name: str = "index_date") -> DataFrame:
        """Each event once per index date with ``ts`` in ``(date, date + days]``."""
        reach = math.ceil(days / SHORTEST_MONTH_DAYS)
        column = F.col(ts)
        scanned = df.where((column > self.start) & (column <= plus_days(self.end, days)))
        spread = scanned.withColumn(name, F.explode(self.near(column, reach, 0)))
        return spread.where(
            F.col(name).between(self.start, self.end)
            & (column > F.col(name))
            & (column <= plus_days(name, days))
        )

    def from_instant(self, df: DataFrame, since: str, name: str = "index_date") -> DataFrame:
        """Each row once per index date at or after ``since`` (NULL gives none).

        The calendar is a short fixed list, so this is a projection, not a
        cross join.
        """
        due = F.filter(self.dates(), lambda day: day >= F.col(since))
        return df.where(F.col(since) <= self.end).withColumn(name, F.explode(due))
