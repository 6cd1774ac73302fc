"""Profile reports over raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.operators import profile as P
from stayrate.operators.joins import coverage, keys_without, orphan_count, union_all
from stayrate.sources.readers import describe

# Coded dates below this are placeholders; the month looked at in detail.
EARLIEST_CODED_DATE = 20000101
FEBRUARY_2017 = (20170201, 20170228)


def activity_report(logs: DataFrame, id_col: str, day: str) -> dict[str, DataFrame]:
    return {
        "schema": describe(logs),
        "rows": P.row_profile(logs, id_col),
        "range": P.ranges(logs, [day]),
        "missing": P.null_profile(logs),
        "sample": P.sample_rows(logs, 5),
    }


def training_report(
    cohort: DataFrame, transactions: DataFrame, id_col: str, label: str, when: str, expiry: str
) -> dict[str, DataFrame]:
    return {
        "cohort": P.row_profile(cohort, id_col),
        "labels": P.share_of_total(cohort, [label], "customers"),
        "transactions": P.row_profile(transactions, id_col),
        "ranges": P.ranges(transactions, [when, expiry]),
        "coverage": coverage(cohort, transactions, id_col),
        "schema": describe(transactions),
        "sample": P.sample_rows(transactions, 5),
    }


def anomaly_reports(
    cohort: DataFrame, transactions: DataFrame, id_col: str, label: str, expiry: str, cancel: str
) -> dict[str, DataFrame]:
    odd = F.col(expiry) < EARLIEST_CODED_DATE
    return {
        "total": P.anomaly_report(transactions, cohort, id_col, odd),
        "by_status": P.anomaly_report(transactions, cohort, id_col, odd, [cancel]),
        "sample": P.sample_rows(transactions.where(odd), 20),
        "labels": P.labels_of_members(cohort, transactions, id_col, label, odd),
    }


def expiry_reports(
    cohort: DataFrame, transactions: DataFrame, id_col: str, label: str, expiry: str
) -> dict[str, DataFrame]:
    february = F.col(expiry).between(*FEBRUARY_2017)
    return {
        "last_valid": P.label_last_valid(cohort, transactions, id_col, label, expiry, EARLIEST_CODED_DATE),
        "distribution": P.last_valid_distribution(cohort, transactions, id_col, expiry, EARLIEST_CODED_DATE),
        "february": P.labels_of_members(cohort, transactions, id_col, label, february),
    }


def timeline_reports(
    cohort: DataFrame, transactions: DataFrame, id_col: str, label: str, when: str, expiry: str
) -> dict[str, DataFrame]:
    return {
        "sample": P.sample_rows(P.entity_timeline(cohort, transactions, id_col, when, expiry), 10),
        "summary": P.label_timeline(cohort, transactions, id_col, label, when, expiry),
        "expiry": P.expiry_quality(transactions, expiry, EARLIEST_CODED_DATE),
    }


def raw_audit(
    tables: Mapping[str, DataFrame],
    id_cols: Mapping[str, str],
    keys: Mapping[str, Sequence[str]],
    dates: Mapping[str, Sequence[str]],
    references: Mapping[str, tuple[str, str, str]],
    population: str,
) -> dict[str, DataFrame]:
    """Inventory, missing values, duplicates, dates and orphans of a set of tables.

    ``references`` maps a table to (its column, other table, other column).
    """
    def tagged(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), "*")

    base = tables[population]
    id_col = id_cols[population]
    return {
        "inventory": P.table_inventory(tables, id_cols),
        "missing": union_all([tagged(n, P.null_profile(t)) for n, t in tables.items()]),
        "duplicates": union_all(
            [
                tagged(n, P.duplicate_profile(tables[n], k, id_cols.get(n)))
                for n, k in keys.items()
            ]
        ),
        "dates": union_all([tagged(n, P.date_quality(tables[n], c)) for n, c in dates.items()]),
        "orphans": union_all(
            [
                tagged(n, orphan_count(tables[n], c, tables[other], oc))
                for n, (c, other, oc) in references.items()
            ]
        ),
        # Tables whose id has another name are told by ``references``.
        "unknown_ids": union_all(
            [
                base.sparkSession.createDataFrame([], "table_name string, unknown_ids long"),
                *[keys_without(tables[n], base, id_col).agg(
                    F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("unknown_ids")
                )
                for n in tables
                if n != population and id_cols.get(n) == id_col],
            ]
        ),
    }
