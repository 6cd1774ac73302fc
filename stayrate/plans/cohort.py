"""Cohort pipeline: three feature tables and the modelling dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.errors import DataQualityError
from stayrate.functions.cleaning import (
    blank_to_null,
    keep_between,
    parse_yyyymmdd,
    row_sum,
    strict_cast,
    tolerant_double,
    tolerant_int,
    tolerant_long,
)
from stayrate.operators.joins import drop_outsiders
from stayrate.operators.profile import distribution, share_of_total, top_values
from stayrate.operators.quality import (
    Watch,
    any_negative,
    any_outside,
    any_present,
    bad_label,
    key_violations,
    one_per_key,
)
from stayrate.operators.windows import (
    Period,
    TransactionColumns,
    date_coverage,
    period_features,
    period_totals,
    transaction_features,
    transaction_totals,
)
from stayrate.session import stage_bucketed, staging
from stayrate.sources.readers import read_parquet
from stayrate.sources.schemas import ACTIVITY_LOG
from stayrate.sources.sinks import publish
from stayrate.streaming.ingest import IngestTotals, ingest_batch
from stayrate.streaming.partials import ingest_partials, totals_from_partials


@dataclass(frozen=True)
class CohortNames:
    """Key and label of the cohort."""

    id: str = "msno"
    label: str = "is_churn"


# The three month windows, latest first, and the closed span they cover.
MONTHS = (
    Period("M1", date(2017, 2, 1), date(2017, 3, 1)),
    Period("M2", date(2017, 1, 1), date(2017, 2, 1)),
    Period("M3", date(2016, 12, 1), date(2017, 1, 1)),
)
FIRST_DAY = date(2016, 12, 1)
LAST_DAY = date(2017, 2, 28)
EARLIEST_EXPIRY = date(2000, 1, 1)
AGE_RANGE = (5, 99)

ACTIVITY_SUMS = ("total_secs", "total_num_unq", "total_song_events")

TRANSACTIONS = TransactionColumns(
    id="msno",
    date="transaction_date",
    paid="actual_amount_paid",
    list_price="plan_list_price",
    plan_days="payment_plan_days",
    auto_renew="is_auto_renew",
    cancel="is_cancel",
    expiry="membership_expire_date",
)


def ingest_activity(spark: SparkSession, source: str, target: str) -> IngestTotals:
    """CSV logs to Parquet with a typed date, in one folder per month.

    A month window then reads only its folders, and the date filter inside
    them reaches the scan; neither works on the date's text.
    """
    day = parse_yyyymmdd("date")
    derived = {"log_date": day, "log_month": F.date_format(day, "yyyy-MM")}
    return ingest_batch(spark, source, target, ACTIVITY_LOG, derived=derived, partition_by=("log_month",))


def activity_window(logs: DataFrame, first: date = FIRST_DAY, last: date = LAST_DAY) -> DataFrame:
    """Only the month folders of the window, where the log is stored by month."""
    if "log_month" not in logs.columns:
        return logs
    return logs.where(F.col("log_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))


def parse_activity(logs: DataFrame, id_col: str = "msno") -> DataFrame:
    """Typed activity log; an unreadable date is NULL. A stored date is kept."""
    stored = F.col("log_date") if "log_date" in logs.columns else parse_yyyymmdd("date")
    return logs.select(
        strict_cast(id_col, "string").alias(id_col),
        stored.alias("log_date"),
        *[
            strict_cast(c, "bigint").alias(c)
            for c in ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")
        ],
        strict_cast("total_secs", "double").alias("total_secs"),
    )


def checked_cohort(cohort: DataFrame, names: CohortNames) -> tuple[DataFrame, int]:
    """The cohort, stored once by id with its gate observed in that write, and its size."""
    keyed = one_per_key(cohort, [names.id], {"_bad": bad_label(names.label)})
    watch = Watch("cohort", {**key_violations([names.id]), "bad_labels": F.col("_bad") > 0}, allow_empty=False)
    stored = stage_bucketed(watch.over(keyed).select(*cohort.columns), "cohort", names.id)
    return stored, watch.check()


def publish_features(
    features: DataFrame,
    cohort_rows: int,
    names: CohortNames,
    subject: str,
    violations: dict,
    output: str,
    table: str | None,
    columns: Sequence[str] | None = None,
) -> None:
    """Store feature rows if there is one per cohort member and no rule is violated.

    ``features`` has one row per id because both sides of its join have; rules may use
    columns besides the stored ``columns``.
    """
    rules = {"missing_ids": F.col(names.id).isNull(), "bad_labels": bad_label(names.label), **violations}
    watch = Watch(subject, rules)
    watched = watch.over(features)
    publish(watched if columns is None else watched.select(*columns), watch, output, cohort_rows, table, names.id)


def behaviour_features(
    cohort: DataFrame,
    logs: DataFrame,
    names: CohortNames = CohortNames(),
    periods: Sequence[Period] = MONTHS,
    cohort_rows: int | None = None,
) -> DataFrame:
    """Active days, sums and daily average per month for every cohort member.

    ``logs`` is the parsed activity log; ``cohort_rows`` saves a count.
    """
    events = row_sum("num_25", "num_50", "num_75", "num_985", "num_100")
    totals = period_totals(
        drop_outsiders(logs, cohort, names.id, cohort_rows),
        names.id,
        "log_date",
        {"total_secs": "total_secs", "total_num_unq": "num_unq", "total_song_events": events},
        periods,
    )
    return period_features(
        cohort, totals, names.id, periods, ACTIVITY_SUMS, "total_secs", "avg_daily_secs"
    )


def ingest_activity_partials(
    spark: SparkSession, source: str, target: str, checkpoint: str, names: CohortNames = CohortNames()
) -> None:
    """Monthly partials of the log files that arrived since the last run."""
    measures = {
        "total_secs": "total_secs",
        "total_num_unq": "num_unq",
        "total_song_events": row_sum("num_25", "num_50", "num_75", "num_985", "num_100"),
    }
    ingest_partials(
        spark, source, target, checkpoint, ACTIVITY_LOG, lambda raw: parse_activity(raw, names.id), names.id, "log_date", measures
    )


def behaviour_from_partials(
    cohort: DataFrame, partials: DataFrame, names: CohortNames = CohortNames(), periods: Sequence[Period] = MONTHS
) -> DataFrame:
    """:func:`behaviour_features` from stored partials: the log is not read."""
    totals = totals_from_partials(partials, names.id, ACTIVITY_SUMS, periods)
    return period_features(cohort, totals, names.id, periods, ACTIVITY_SUMS, "total_secs", "avg_daily_secs")


def behaviour_flow(
    cohort: DataFrame, raw_logs: DataFrame, output: str, names: CohortNames = CohortNames(), table: str | None = None
) -> DataFrame:
    """Gate, build, and store the behaviour features that pass; returns the date report.

    With ``table`` they are stored by id under that name, here and in the other flows.
    """
    logs = parse_activity(raw_logs, names.id)
    report = date_coverage(logs, ["log_date"], "log_date", FIRST_DAY, LAST_DAY)
    window = parse_activity(activity_window(raw_logs), names.id)
    with staging(cohort.sparkSession):
        stored, cohort_rows = checked_cohort(cohort, names)
        days = [f"active_days_{p.suffix}" for p in MONTHS]
        averages = [f"avg_daily_secs_{p.suffix}" for p in MONTHS]
        publish_features(
            behaviour_features(stored, window, names, MONTHS, cohort_rows),
            cohort_rows,
            names,
            "behaviour features",
            {"negative_days": any_negative(days), "negative_averages": any_negative(averages)},
            output,
            table,
        )
    return report


def parse_transactions(raw: DataFrame, id_col: str = "msno") -> DataFrame:
    """All-text transactions to types; whatever does not parse is NULL."""
    return raw.select(
        strict_cast(id_col, "string").alias(id_col),
        *[
            tolerant_int(c).alias(c)
            for c in ("payment_method_id", "payment_plan_days", "is_auto_renew", "is_cancel")
        ],
        *[tolerant_double(c).alias(c) for c in ("plan_list_price", "actual_amount_paid")],
        *[parse_yyyymmdd(c).alias(c) for c in ("transaction_date", "membership_expire_date")],
    )


def transaction_flow(
    cohort: DataFrame, raw: DataFrame, output: str, names: CohortNames = CohortNames(), table: str | None = None
) -> dict[str, DataFrame]:
    """Gate, build, and store the transaction features that pass; returns source reports."""
    parsed = parse_transactions(raw, names.id)
    inside = parsed.where(F.col("transaction_date").between(F.lit(FIRST_DAY), F.lit(LAST_DAY)))
    with staging(cohort.sparkSession):
        stored, cohort_rows = checked_cohort(cohort, names)
        totals = transaction_totals(
            drop_outsiders(parsed, stored, names.id, cohort_rows),
            TRANSACTIONS,
            FIRST_DAY,
            LAST_DAY,
            EARLIEST_EXPIRY,
        )
        rates = ["auto_renew_rate", "cancellation_rate"]
        windowed = ["avg_amount_paid", "avg_payment_plan_days", *rates, "transaction_recency_days"]
        publish_features(
            transaction_features(stored, totals, names.id),
            cohort_rows,
            names,
            "transaction features",
            {
                "negative_counts": any_negative(["transaction_count", "valid_expiry_count"]),
                "invalid_rates": any_outside(rates, 0, 1),
                "negative_recency": F.col("transaction_recency_days") < 0,
                "inconsistent_empty": (F.col("transaction_count") == 0) & any_present(windowed),
            },
            output,
            table,
        )
    return {
        "dates": date_coverage(
            parsed, ["transaction_date", "membership_expire_date"], "transaction_date", FIRST_DAY, LAST_DAY
        ),
        "auto_renew": distribution(inside, ["is_auto_renew"]),
        "cancel": distribution(inside, ["is_cancel"]),
    }


def clean_members(raw: DataFrame, id_col: str = "msno") -> DataFrame:
    """All-text members to city, gender, age, channel and registration month."""
    registered = parse_yyyymmdd(tolerant_long("registration_init_time"))
    return raw.select(
        strict_cast(id_col, "string").alias(id_col),
        tolerant_int("city").alias("city"),
        blank_to_null("gender").alias("gender"),
        keep_between(tolerant_int("bd"), *AGE_RANGE).alias("age"),
        tolerant_int("registered_via").alias("registered_via"),
        F.year(registered).alias("registration_year"),
        F.month(registered).alias("registration_month"),
    )


def member_features(cohort: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """Cohort LEFT JOIN cleaned members."""
    return cohort.join(members, id_col, "left")


def member_flow(
    cohort: DataFrame, raw: DataFrame, output: str, names: CohortNames = CohortNames(), table: str | None = None
) -> dict[str, DataFrame]:
    """Gate, clean, join, and store the member features that pass; returns profiles.

    All members must be there once, also those outside the cohort: the members are
    combined by id, and the join keeps the outsiders until they are counted.
    """
    with staging(cohort.sparkSession):
        stored, cohort_rows = checked_cohort(cohort, names)
        members = clean_members(raw, names.id)
        keyed = one_per_key(members, [names.id], times="_member")
        joined = stored.withColumn("_inside", F.lit(True)).join(keyed, names.id, "full")
        inside = F.coalesce(F.col("_inside"), F.lit(False))
        rules = {
            "cohort_ids_missing": inside & F.col(names.id).isNull(),
            "member_ids_missing": ~inside & F.col(names.id).isNull(),
            "repeated_members": F.col("_member") > 1,
            "bad_labels": inside & bad_label(names.label),
            "invalid_age": inside & ~F.col("age").between(*AGE_RANGE),
            "invalid_month": inside & ~F.col("registration_month").between(1, 12),
        }
        watch = Watch("member features", rules, counted=inside)
        kept = [*stored.columns, *[c for c in members.columns if c != names.id]]
        # Outsiders are counted by the watch and dropped by the task that writes the rest.
        publish(watch.over(joined).where(inside).select(*kept), watch, output, cohort_rows, table, names.id)
    return {
        "gender": distribution(members, ["gender"]),
        "city": top_values(members, "city"),
        "channel": distribution(members, ["registered_via"]),
        "missing": members.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("registration_year").isNull()).alias("invalid_registration_dates"),
            F.count_if(F.col("age").isNull()).alias("missing_or_invalid_age"),
        ),
    }


def watched_groups(tables: Sequence[DataFrame], names: CohortNames) -> DataFrame:
    """The first feature group with those of the others beside it, one row per id, and for
    each group i ``_n{i}`` (rows of the id, NULL for none) and ``_l{i}`` (label).

    A feature that several groups have is the first's. Groups stored by id with equal
    buckets are joined as they lie: a left join leaves the rows dealt as they were.
    """
    joined = None
    for i, group in enumerate(tables):
        own = [c for c in group.columns if joined is None or c == names.id or c not in joined.columns]
        keyed = one_per_key(group.select(*own).withColumnRenamed(names.label, f"_l{i}"), [names.id], times=f"_n{i}")
        joined = keyed if joined is None else joined.join(keyed, names.id, "left")
    return joined


def group_sizes(tables: Sequence[DataFrame]) -> list[int]:
    """Rows of each table, in one job that reads no column."""
    marks = [t.select(F.lit(i).alias("i")) for i, t in enumerate(tables)]
    row = reduce(DataFrame.unionAll, marks).agg(*[F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(len(tables))])
    return list(row.first())


def model_dataset_flow(
    behaviour: DataFrame,
    transactions: DataFrame,
    members: DataFrame,
    output: str,
    names: CohortNames = CohortNames(),
    table: str | None = None,
) -> DataFrame:
    """Join the three sources and store the result if it passes; returns the label shares.

    The sources must be of one size; all else is counted by the job that writes: ids
    missing or repeated, ids of the first that another lacks (with equal sizes there are
    then none the other way), labels that differ, counts below zero.
    """
    groups = [behaviour, transactions, members]
    sizes = group_sizes(groups)
    if len(set(sizes)) != 1:
        raise DataQualityError("feature tables differ in size", dict(zip(("behaviour", "transactions", "members"), sizes)))
    joined = watched_groups(groups, names)
    held = [F.col(f"_n{i}").isNotNull() for i in range(len(groups))]
    everywhere = reduce(lambda a, b: a & b, held)
    counts = ["transaction_count", "valid_expiry_count", *[f"active_days_{p.suffix}" for p in MONTHS]]
    differ = reduce(lambda a, b: a | b, [~F.col(f"_l{i}").eqNullSafe(F.col("_l0")) for i in range(1, len(groups))])
    rules = {
        "missing_ids": F.col(names.id).isNull(),
        "repeated_ids": reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_n{i}") > 1, F.lit(False)) for i in range(len(groups))]),
        "absent from a source": ~everywhere,
        "labels differ": everywhere & differ,
        "bad_labels": everywhere & bad_label("_l0"),
        "invalid_counts": any_negative(counts),
    }
    watch = Watch("model dataset", rules, allow_empty=False)
    kept = list(dict.fromkeys(c for g in groups for c in g.columns))
    dataset = watch.over(joined).withColumnRenamed("_l0", names.label).select(*kept)
    publish(dataset, watch, output, sizes[0], table, names.id)
    return share_of_total(read_parquet(behaviour.sparkSession, output), [names.label], "customers")
