"""Data-quality gates.

A gate is one aggregate row of violation counters. ``audit`` returns the
row as a DataFrame; ``require`` runs it and raises when a counter is not zero.
``Watch`` takes the same counters in the job that writes the rows, so checking costs no
pass of its own; keys are checked on the aggregate that makes one row of each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.errors import DataQualityError


def audit(df: DataFrame, violations: Mapping[str, Column]) -> DataFrame:
    """One row: ``rows`` and, per name, how many rows violate the condition."""
    counters = [F.count_if(condition).alias(name) for name, condition in violations.items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counters)


def require(
    df: DataFrame,
    violations: Mapping[str, Column],
    subject: str,
    allow_empty: bool = True,
) -> int:
    """Run :func:`audit`; raise on any violation, else return the row count."""
    result = audit(df, violations).first().asDict()
    rows = result.pop("rows")
    failing = {name: count for name, count in result.items() if count}
    if not allow_empty and rows == 0:
        failing["empty"] = 1
    if failing:
        raise DataQualityError(subject, failing)
    return rows


class Watch:
    """Violation counters observed while another job reads the rows.

    ``over`` puts the counters on top of a DataFrame, as the last step before it is
    written: then each row is counted by the task that writes it, once. ``check`` raises
    when a counter is not zero or the rows (those that are ``counted``) are not as many as
    they should be.
    """

    def __init__(
        self, subject: str, violations: Mapping[str, Column], allow_empty: bool = True, counted: Column | None = None
    ):
        self.subject = subject
        self._allow_empty = allow_empty
        self._rows = F.count(F.lit(1)) if counted is None else F.count_if(counted)
        self._seen = Observation(f"{subject} {uuid.uuid4().hex}")
        self._counters = [F.count_if(condition).alias(name) for name, condition in violations.items()]

    def over(self, df: DataFrame) -> DataFrame:
        return df.observe(self._seen, self._rows.alias("rows"), *self._counters)

    def check(self, rows: int | None = None) -> int:
        """Row count of the finished job."""
        found = dict(self._seen.get)
        seen = found.pop("rows")
        failing = {name: count for name, count in found.items() if count}
        if not self._allow_empty and seen == 0:
            failing["empty"] = 1
        if rows is not None and rows != seen:
            failing |= {"rows": seen, "expected_rows": rows}
        if failing:
            raise DataQualityError(self.subject, failing)
        return seen


def one_per_key(df: DataFrame, keys: Sequence[str], counted: Mapping[str, Column] | None = None, times: str = "_times") -> DataFrame:
    """One row per key: any value of each other column, ``times``, and for each condition
    of ``counted`` how many of the key's rows meet it.

    For tables that should have the key once: the rows are combined by key for what
    follows anyway, and ``times`` and the counters tell whether they should have been.
    """
    others = [F.first(c).alias(c) for c in df.columns if c not in set(keys)]
    conditions = [F.count_if(condition).alias(name) for name, condition in (counted or {}).items()]
    return df.groupBy(*keys).agg(*others, F.count(F.lit(1)).alias(times), *conditions)


def key_violations(keys: Sequence[str], times: str = "_times") -> dict[str, Column]:
    """Rules for rows of :func:`one_per_key`: no key part missing, no key repeated."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return {"missing_keys": missing, "repeated_keys": ~missing & (F.col(times) > 1)}


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, rows with a missing key part, repeated-key rows.

    Rows are counted per key first, so the job is two plain aggregations and
    a frequent key is pre-aggregated before the shuffle.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.select("n", missing.alias("missing")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(~F.col("missing")).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing_keys"),
        F.coalesce(
            F.sum(F.when(~F.col("missing"), F.col("n") - 1)), F.lit(0)
        ).alias("repeated_rows"),
    )


def require_unique_key(df: DataFrame, keys: Sequence[str] | str, subject: str) -> int:
    """Key present and unique in every row; returns the row count."""
    names = [keys] if isinstance(keys, str) else list(keys)
    row = key_report(df, names).first()
    failing = {
        name: row[name] for name in ("missing_keys", "repeated_rows") if row[name]
    }
    if failing:
        raise DataQualityError(subject, failing)
    return row["rows"]


def require_columns(df: DataFrame, columns: Sequence[str], subject: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataQualityError(f"{subject}: missing columns {missing}", {"missing_columns": len(missing)})


def require_numeric(df: DataFrame, columns: Sequence[str], subject: str) -> None:
    wrong = [
        f.name
        for f in df.schema.fields
        if f.name in set(columns) and not isinstance(f.dataType, T.NumericType | T.BooleanType)
    ]
    if wrong:
        raise DataQualityError(f"{subject}: not numeric {wrong}", {"not_numeric": len(wrong)})


def require_absent(columns: Sequence[str], prohibited: Sequence[str], subject: str) -> None:
    """No leaky column among the predictors."""
    leaky = sorted(set(columns) & set(prohibited))
    if leaky:
        raise DataQualityError(f"{subject}: prohibited {leaky}", {"prohibited": len(leaky)})


def bad_label(label: str) -> Column:
    """Label missing or not 0/1."""
    return F.col(label).isNull() | ~F.col(label).isin(0, 1)


def any_negative(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) < 0 for c in columns])


def any_outside(columns: Sequence[str], low, high) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(c).between(low, high) for c in columns])


def any_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def cohort_gate(df: DataFrame, id_col: str, label: str, subject: str = "cohort") -> int:
    """Unique non-null ids and labels in {0, 1}; returns the cohort size."""
    rows = require_unique_key(df, id_col, subject)
    require(df, {"bad_labels": bad_label(label)}, subject, allow_empty=False)
    return rows


def require_same_keys(left: DataFrame, right: DataFrame, key: str, subject: str) -> None:
    """Both sides hold the same set of keys."""
    row = (
        left.select(key).distinct().withColumn("in_left", F.lit(1))
        .join(right.select(key).distinct().withColumn("in_right", F.lit(1)), key, "full")
        .agg(
            F.count_if(F.col("in_right").isNull()).alias("only_left"),
            F.count_if(F.col("in_left").isNull()).alias("only_right"),
        )
        .first()
    )
    failing = {name: row[name] for name in ("only_left", "only_right") if row[name]}
    if failing:
        raise DataQualityError(subject, failing)


def require_both_classes(df: DataFrame, label: str, subject: str) -> dict[int, int]:
    """Row counts of classes 0 and 1, both present."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    ).first()
    if not row["negatives"] or not row["positives"]:
        raise DataQualityError(
            f"{subject}: one class only",
            {"negatives": row["negatives"], "positives": row["positives"]},
        )
    return {0: row["negatives"], 1: row["positives"]}


def require_chronological(df: DataFrame, split: str, when: str, order: Sequence[str]) -> None:
    """Every split non-empty and each one wholly before the next."""
    spans = {
        r[split]: (r["first"], r["last"])
        for r in df.where(F.col(split).isin(*order))
        .groupBy(split)
        .agg(F.min(when).alias("first"), F.max(when).alias("last"))
        .collect()
    }
    absent = [name for name in order if name not in spans]
    if absent:
        raise DataQualityError(f"splits without rows {absent}", {"empty_splits": len(absent)})
    overlaps = [b for a, b in zip(order, order[1:]) if spans[a][1] >= spans[b][0]]
    if overlaps:
        raise DataQualityError(f"splits not in date order {overlaps}", {"overlaps": len(overlaps)})
