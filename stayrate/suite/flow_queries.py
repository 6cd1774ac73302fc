"""Whole cohort flows over tables derived from the given ones: gates, features, stored
results read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.plans import cohort as C
from stayrate.plans import training
from stayrate.session import work_path
from stayrate.sources.readers import read_parquet
from stayrate.suite import inputs as I
from stayrate.suite.preparation_queries import split_sql

_DAY = "date_add(DATE '2016-11-20', CAST({0} % 110 AS INT))"


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cohort(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("msno"), "is_churn")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raw activity log; every 17th date is unreadable."""
    day = F.date_format(F.expr(_DAY.format("event_id")), "yyyyMMdd")
    number = lambda n: (F.col("event_id") % n).cast("string")
    return I.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("msno"),
        F.when(F.col("event_id") % 17 != 0, day).otherwise("20170230").alias("date"),
        *[number(n).alias(c) for c, n in (("num_25", 5), ("num_50", 3), ("num_75", 2), ("num_985", 7), ("num_100", 11), ("num_unq", 4))],
        F.col("value").cast("string").alias("total_secs"),
    )


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw transactions with unreadable prices and unknown expiries."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    day = F.expr(_DAY.format("o_orderkey"))
    return I.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("msno"),
        (key % 40).cast("string").alias("payment_method_id"),
        (key % 90).cast("string").alias("payment_plan_days"),
        F.when(priority != "3-MEDIUM", (key % 500).cast("string")).otherwise("n/a").alias("plan_list_price"),
        F.when(priority != "2-HIGH", (key % 300).cast("string")).otherwise("").alias("actual_amount_paid"),
        F.when(priority != "5-LOW", (key % 2).cast("string")).alias("is_auto_renew"),
        F.date_format(day, "yyyyMMdd").alias("transaction_date"),
        F.when(priority == "1-URGENT", "19700101").otherwise(F.date_format(F.date_add(day, 30), "yyyyMMdd")).alias("membership_expire_date"),
        (F.col("o_orderstatus") == "F").cast("int").cast("string").alias("is_cancel"),
    )


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.raw_members(spark, sf_dir).select(
        F.col("c_custkey").cast("string").alias("msno"),
        "city",
        "gender",
        F.col("age_text").alias("bd"),
        F.col("city").alias("registered_via"),
        F.col("registered").alias("registration_init_time"),
    )


def _stored(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh path and catalogue name of a flow's output."""
    path = work_path(spark, f"flow-{name}")
    return path, f"{name}_{path[-12:]}"


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, table = _stored(spark, "behaviour")
    C.behaviour_flow(_cohort(spark, sf_dir), _logs(spark, sf_dir), path, table=table)
    return spark.table(table)


def behaviour_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _behaviour(spark, sf_dir)
    df = I.rounded(df, [f"total_secs_{p.suffix}" for p in C.MONTHS], 4)
    return I.rounded(df, [f"avg_daily_secs_{p.suffix}" for p in C.MONTHS], 7)


def behaviour_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features from monthly partials, the log arriving in two parts."""
    path = work_path(spark, "partials")
    logs = _logs(spark, sf_dir).select(*C.ACTIVITY_LOG.fieldNames())
    half = F.pmod(F.xxhash64("msno", "date", "total_secs"), F.lit(2))
    for part in (0, 1):
        logs.where(half == part).write.mode("append").option("header", True).csv(f"{path}/log")
        C.ingest_activity_partials(spark, f"{path}/log", f"{path}/months", f"{path}/checkpoint")
    df = C.behaviour_from_partials(_cohort(spark, sf_dir), read_parquet(spark, f"{path}/months"))
    df = I.rounded(df, [f"total_secs_{p.suffix}" for p in C.MONTHS], 4)
    return I.rounded(df, [f"avg_daily_secs_{p.suffix}" for p in C.MONTHS], 7)


def behaviour_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date report the flow returns."""
    return C.behaviour_flow(_cohort(spark, sf_dir), _logs(spark, sf_dir), work_path(spark, "flow-behaviour"))


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, table = _stored(spark, "transactions")
    C.transaction_flow(_cohort(spark, sf_dir), _transactions(spark, sf_dir), path, table=table)
    return spark.table(table)


def transaction_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _paid(spark, sf_dir)
    return I.rounded(df, ["avg_amount_paid", "avg_payment_plan_days", "auto_renew_rate", "cancellation_rate"], 7)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, table = _stored(spark, "members")
    C.member_flow(_cohort(spark, sf_dir), _members(spark, sf_dir), path, table=table)
    return spark.table(table)


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, table = _stored(spark, "dataset")
    tables = [build(spark, sf_dir) for build in (_behaviour, _paid, _profiles)]
    C.model_dataset_flow(*tables, path, table=table)
    return spark.table(table)


def dataset_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and members of the joined table, which holds no rounding."""
    days = [f"active_days_{p.suffix}" for p in C.MONTHS]
    columns = ["msno", "is_churn", *days, "transaction_count", "valid_expiry_count", "city", "gender", "age"]
    return _dataset(spark, sf_dir).select(*columns, "registered_via", "registration_year", "registration_month")


def split_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored assignments of the joined table."""
    path = work_path(spark, "flow-split")
    training.split_flow(_dataset(spark, sf_dir), "msno", "is_churn", path)
    return read_parquet(spark, f"{path}/split_assignments")


QUERIES = {
    "flow_behaviour": behaviour_flow,
    "flow_behaviour_incremental": behaviour_incremental,
    "flow_behaviour_dates": behaviour_dates,
    "flow_transactions": transaction_flow,
    "flow_members": _profiles,
    "flow_dataset": dataset_flow,
    "flow_split": split_flow,
}

_COHORT_SQL = "cohort AS (SELECT CAST(c_custkey AS VARCHAR) AS msno, CAST(c_acctbal < 0 AS INTEGER) AS is_churn FROM customer)"

_LOGS_SQL = """logs AS (
  SELECT CAST(user_id AS VARCHAR) AS msno,
         CASE WHEN event_id % 17 != 0 THEN DATE '2016-11-20' + CAST(event_id % 110 AS INTEGER) END AS log_date,
         event_id % 5 + event_id % 3 + event_id % 2 + event_id % 7 + event_id % 11 AS songs,
         event_id % 4 AS num_unq, value AS secs FROM events)"""


def _month_sql() -> str:
    inner, outer, averages = [], [], []
    for p in C.MONTHS:
        x, inside = p.suffix, f"log_date >= DATE '{p.start}' AND log_date < DATE '{p.end}'"
        inner += [
            f"count(DISTINCT log_date) FILTER (WHERE {inside}) AS d_{x}",
            f"sum(secs) FILTER (WHERE {inside}) AS s_{x}",
            f"sum(num_unq) FILTER (WHERE {inside}) AS u_{x}",
            f"sum(songs) FILTER (WHERE {inside}) AS e_{x}",
        ]
        outer += [
            f"coalesce(d_{x}, 0) AS active_days_{x}",
            f"round(coalesce(s_{x}, 0), 4) AS total_secs_{x}",
            f"CAST(coalesce(u_{x}, 0) AS BIGINT) AS total_num_unq_{x}",
            f"CAST(coalesce(e_{x}, 0) AS BIGINT) AS total_song_events_{x}",
        ]
        averages.append(f"round(coalesce(s_{x}, 0) / NULLIF(d_{x}, 0), 7) AS avg_daily_secs_{x}")
    return f"""by_month AS (SELECT msno, {', '.join(inner)} FROM logs GROUP BY msno),
behaviour AS (SELECT c.msno, c.is_churn, {', '.join(outer + averages)}
  FROM cohort c LEFT JOIN by_month m ON c.msno = m.msno)"""


_BEHAVIOUR_SQL = f"{_COHORT_SQL},\n{_LOGS_SQL},\n{_month_sql()}"

_PAID_SQL = """raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS msno, o_orderkey % 90 AS plan_days,
         CASE WHEN o_orderpriority != '3-MEDIUM' THEN CAST(o_orderkey % 500 AS DOUBLE) END AS listed,
         CASE WHEN o_orderpriority != '2-HIGH' THEN CAST(o_orderkey % 300 AS DOUBLE) END AS paid,
         CASE WHEN o_orderpriority != '5-LOW' THEN o_orderkey % 2 END AS renew,
         DATE '2016-11-20' + CAST(o_orderkey % 110 AS INTEGER) AS happened,
         CASE WHEN o_orderpriority = '1-URGENT' THEN DATE '1970-01-01'
              ELSE DATE '2016-11-20' + CAST(o_orderkey % 110 AS INTEGER) + 30 END AS expiry,
         CAST(o_orderstatus = 'F' AS INTEGER) AS cancel FROM orders),
sums AS (
  SELECT msno, count(*) AS n, sum(paid) AS paid, avg(paid) AS mean_paid, sum(listed) AS listed, avg(plan_days) AS days,
         sum(CASE WHEN renew = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS renews,
         sum(cancel)::DOUBLE / count(*) AS cancels, max(happened) AS latest,
         count(*) FILTER (WHERE expiry >= DATE '2000-01-01') AS valid
  FROM raw WHERE happened BETWEEN DATE '2016-12-01' AND DATE '2017-02-28' GROUP BY msno),
paid AS (
  SELECT c.msno, c.is_churn, coalesce(n, 0) AS transaction_count, coalesce(paid, 0) AS total_amount_paid,
         round(mean_paid, 7) AS avg_amount_paid, coalesce(listed, 0) AS total_plan_list_price,
         round(days, 7) AS avg_payment_plan_days, round(renews, 7) AS auto_renew_rate,
         round(cancels, 7) AS cancellation_rate,
         CAST(date_diff('day', latest, DATE '2017-02-28') AS INTEGER) AS transaction_recency_days,
         coalesce(valid, 0) AS valid_expiry_count
  FROM cohort c LEFT JOIN sums s ON c.msno = s.msno)"""

_PROFILES_SQL = I.RAW_MEMBERS_SQL + """,
profiles AS (
  SELECT CAST(m.c_custkey AS VARCHAR) AS msno, CAST(c_acctbal < 0 AS INTEGER) AS is_churn,
         TRY_CAST(m.city AS INTEGER) AS city, NULLIF(TRIM(m.gender), '') AS gender,
         CASE WHEN TRY_CAST(age_text AS INTEGER) BETWEEN 5 AND 99 THEN TRY_CAST(age_text AS INTEGER) END AS age,
         TRY_CAST(m.city AS INTEGER) AS registered_via,
         CAST(year(CAST(TRY_STRPTIME(registered, '%Y%m%d') AS DATE)) AS INTEGER) AS registration_year,
         CAST(month(CAST(TRY_STRPTIME(registered, '%Y%m%d') AS DATE)) AS INTEGER) AS registration_month
  FROM raw_members m JOIN customer c ON m.c_custkey = c.c_custkey)"""

ORACLES = {
    "flow_behaviour": I.with_ctes(_BEHAVIOUR_SQL, select="SELECT * FROM behaviour"),
    "flow_behaviour_incremental": I.with_ctes(_BEHAVIOUR_SQL, select="SELECT * FROM behaviour"),
    "flow_behaviour_dates": I.with_ctes(
        _LOGS_SQL,
        select="""SELECT count(*) AS total_rows, count(*) FILTER (WHERE log_date IS NULL) AS invalid_log_date,
  count(*) FILTER (WHERE log_date BETWEEN DATE '2016-12-01' AND DATE '2017-02-28') AS rows_in_window FROM logs""",
    ),
    "flow_transactions": I.with_ctes(_COHORT_SQL, _PAID_SQL, select="SELECT * FROM paid"),
    "flow_members": I.with_ctes(_PROFILES_SQL, select="SELECT * FROM profiles"),
    "flow_dataset": I.with_ctes(
        _BEHAVIOUR_SQL,
        _PAID_SQL,
        _PROFILES_SQL,
        select="""SELECT b.msno, b.is_churn, active_days_M1, active_days_M2, active_days_M3, transaction_count,
  valid_expiry_count, city, gender, age, registered_via, registration_year, registration_month
FROM behaviour b JOIN paid p ON b.msno = p.msno JOIN profiles q ON b.msno = q.msno""",
    ),
    "flow_split": I.with_ctes(
        _COHORT_SQL, split_sql("cohort", "msno", "is_churn"), select="SELECT msno, split FROM split"
    ),
}
