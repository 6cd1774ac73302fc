"""Cohort features on customers, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.cleaning import (
    blank_to_null,
    keep_between,
    parse_yyyymmdd,
    tolerant_int,
)
from stayrate.operators.joins import drop_outsiders, inner_all, label_disagreements
from stayrate.operators.profile import distribution, share_of_total
from stayrate.operators.quality import any_outside, any_present, audit, bad_label
from stayrate.operators.windows import (
    date_coverage,
    period_features,
    period_totals,
    transaction_features,
    transaction_totals,
)
from stayrate.suite import inputs as I

SUMS = ["total_secs", "total_num_unq", "total_song_events"]


def period_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = I.cohort(spark, sf_dir)
    logs = drop_outsiders(I.activity(spark, sf_dir), cohort, "c_custkey")
    totals = period_totals(logs, "c_custkey", "ts", {n: n for n in SUMS}, I.PERIODS)
    return period_features(cohort, totals, "c_custkey", I.PERIODS, SUMS, "total_secs", "avg_daily_secs")


def period_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = period_table(spark, sf_dir)
    names = [f"total_secs_{p.suffix}" for p in I.PERIODS]
    averages = [f"avg_daily_secs_{p.suffix}" for p in I.PERIODS]
    return I.rounded(I.rounded(df, names, 4), averages, 7)


def _period_sql(digits: bool) -> str:
    parts, outer, averages = [], [], []
    for p in I.PERIODS:
        inside = f"ts >= TIMESTAMP '{p.start}' AND ts < TIMESTAMP '{p.end}'"
        parts.append(f"count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE {inside}) AS active_days_{p.suffix}")
        parts += [f"sum({n}) FILTER (WHERE {inside}) AS {n}_{p.suffix}" for n in SUMS]
        secs = f"coalesce(total_secs_{p.suffix}, 0)"
        outer.append(f"coalesce(active_days_{p.suffix}, 0) AS active_days_{p.suffix}")
        outer.append((f"round({secs}, 4)" if digits else secs) + f" AS total_secs_{p.suffix}")
        outer += [f"CAST(coalesce({n}_{p.suffix}, 0) AS BIGINT) AS {n}_{p.suffix}" for n in SUMS[1:]]
        ratio = f"total_secs_{p.suffix} / NULLIF(active_days_{p.suffix}, 0)"
        averages.append((f"round({ratio}, 7)" if digits else ratio) + f" AS avg_daily_secs_{p.suffix}")
    return f"""monthly AS (SELECT c_custkey, {', '.join(parts)} FROM activity GROUP BY c_custkey),
behaviour AS (SELECT c.c_custkey, c.is_churn, {', '.join(outer + averages)}
  FROM cohort c LEFT JOIN monthly m ON c.c_custkey = m.c_custkey)"""


BEHAVIOUR_SQL = f"{I.COHORT_SQL},\n{I.ACTIVITY_SQL},\n{_period_sql(True)}"


def transaction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = I.cohort(spark, sf_dir)
    facts = drop_outsiders(I.transactions(spark, sf_dir), cohort, "c_custkey")
    totals = transaction_totals(facts, I.TRANSACTION_NAMES, I.WINDOW_START, I.WINDOW_END, I.EARLIEST)
    return transaction_features(cohort, totals, "c_custkey")


def transaction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transaction_table(spark, sf_dir)
    df = I.rounded(df, ["total_amount_paid", "total_plan_list_price"], 4)
    return I.rounded(
        df, ["avg_amount_paid", "avg_payment_plan_days", "auto_renew_rate", "cancellation_rate"], 7
    )


TRANSACTION_FEATURES_SQL = f"""{I.TRANSACTIONS_SQL},
totals AS (
  SELECT c_custkey, count(*) AS transaction_count, sum(amount_paid) AS total_amount_paid,
         avg(amount_paid) AS avg_amount_paid, sum(list_price) AS total_plan_list_price,
         avg(plan_days) AS avg_payment_plan_days,
         sum(CASE WHEN is_auto_renew = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS auto_renew_rate,
         sum(CASE WHEN is_cancel = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS cancellation_rate,
         CAST(date_diff('day', max(transaction_date), DATE '2001-08-01') AS INTEGER) AS transaction_recency_days,
         count(*) FILTER (WHERE expiry >= DATE '2000-01-01') AS valid_expiry_count
  FROM transactions WHERE transaction_date BETWEEN DATE '2001-01-01' AND DATE '2001-08-01'
  GROUP BY c_custkey),
transaction_features AS (
  SELECT c.c_custkey, c.is_churn, coalesce(transaction_count, 0) AS transaction_count,
         round(coalesce(total_amount_paid, 0), 4) AS total_amount_paid,
         round(avg_amount_paid, 7) AS avg_amount_paid,
         round(coalesce(total_plan_list_price, 0), 4) AS total_plan_list_price,
         round(avg_payment_plan_days, 7) AS avg_payment_plan_days,
         round(auto_renew_rate, 7) AS auto_renew_rate, round(cancellation_rate, 7) AS cancellation_rate,
         transaction_recency_days, coalesce(valid_expiry_count, 0) AS valid_expiry_count
  FROM cohort c LEFT JOIN totals t ON c.c_custkey = t.c_custkey)"""


def member_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = parse_yyyymmdd("registered")
    members = I.raw_members(spark, sf_dir).select(
        "c_custkey",
        tolerant_int("city").alias("city"),
        blank_to_null("gender").alias("gender"),
        keep_between(tolerant_int("age_text"), 5, 99).alias("age"),
        F.year(registered).alias("registration_year"),
        F.month(registered).alias("registration_month"),
    )
    return I.cohort(spark, sf_dir).join(members, "c_custkey", "left")


MEMBER_FEATURES_SQL = f"""{I.MEMBERS_SQL},
member_features AS (
  SELECT c.c_custkey, c.is_churn, m.* EXCLUDE (c_custkey)
  FROM cohort c LEFT JOIN members m ON c.c_custkey = m.c_custkey)"""


def model_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_all(
        [
            period_query(spark, sf_dir),
            transaction_query(spark, sf_dir).drop("is_churn"),
            member_table(spark, sf_dir).drop("is_churn"),
        ],
        "c_custkey",
    )


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from three rules that differ on purpose."""
    customers = I.table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    rules = [balance < 0, balance < 100, F.when(F.col("c_mktsegment") != "MACHINERY", balance < 0)]
    tables = [customers.select("c_custkey", r.cast("int").alias("is_churn")) for r in rules]
    return label_disagreements(tables, "c_custkey", "is_churn")


def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate counters of the transaction features in one row."""
    rates = ["auto_renew_rate", "cancellation_rate"]
    return audit(
        transaction_table(spark, sf_dir),
        {
            "bad_labels": bad_label("is_churn"),
            "invalid_rates": any_outside(rates, 0, 1),
            "above_half": F.col("cancellation_rate") > 0.5,
            "negative_recency": F.col("transaction_recency_days") < 0,
            "empty_windows": (F.col("transaction_count") == 0) & F.col("avg_amount_paid").isNull(),
            "inconsistent_empty": (F.col("transaction_count") == 0)
            & any_present(["avg_amount_paid", *rates, "transaction_recency_days"]),
        },
    )


def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = I.raw_members(spark, sf_dir).select(parse_yyyymmdd("registered").alias("registered"))
    return date_coverage(registered, ["registered"], "registered", I.EARLIEST, I.WINDOW_END)


def auto_renew_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("transaction_date").between(F.lit(I.WINDOW_START), F.lit(I.WINDOW_END))
    return distribution(I.transactions(spark, sf_dir).where(inside), ["is_auto_renew", "is_cancel"])


def label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_of_total(I.cohort(spark, sf_dir), ["is_churn"], "customers")


QUERIES = {
    "period_features": period_query,
    "transaction_features": transaction_query,
    "member_features": member_table,
    "model_dataset": model_dataset,
    "label_agreement": label_agreement,
    "feature_audit": feature_audit,
    "window_coverage": window_coverage,
    "auto_renew_counts": auto_renew_counts,
    "label_share": label_share,
}

ORACLES = {
    "period_features": I.with_ctes(BEHAVIOUR_SQL, select="SELECT * FROM behaviour"),
    "transaction_features": I.with_ctes(
        I.COHORT_SQL, TRANSACTION_FEATURES_SQL, select="SELECT * FROM transaction_features"
    ),
    "member_features": I.with_ctes(I.COHORT_SQL, MEMBER_FEATURES_SQL, select="SELECT * FROM member_features"),
    "model_dataset": I.with_ctes(
        BEHAVIOUR_SQL,
        TRANSACTION_FEATURES_SQL,
        MEMBER_FEATURES_SQL,
        select="""SELECT b.*, t.* EXCLUDE (c_custkey, is_churn), m.* EXCLUDE (c_custkey, is_churn)
FROM behaviour b JOIN transaction_features t ON b.c_custkey = t.c_custkey
JOIN member_features m ON b.c_custkey = m.c_custkey""",
    ),
    "label_agreement": """WITH l AS (
  SELECT c_acctbal < 0 AS a, c_acctbal < 100 AS b,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal < 0 END AS c FROM customer)
SELECT count(*) FILTER (WHERE a <> b OR a <> c OR a IS NULL OR b IS NULL OR c IS NULL) AS disagreements FROM l""",
    "feature_audit": I.with_ctes(
        I.COHORT_SQL,
        TRANSACTION_FEATURES_SQL,
        select="""SELECT count(*) AS rows,
  count(*) FILTER (WHERE is_churn IS NULL OR is_churn NOT IN (0, 1)) AS bad_labels,
  count(*) FILTER (WHERE auto_renew_rate < 0 OR auto_renew_rate > 1
    OR cancellation_rate < 0 OR cancellation_rate > 1) AS invalid_rates,
  count(*) FILTER (WHERE cancellation_rate > 0.5) AS above_half,
  count(*) FILTER (WHERE transaction_recency_days < 0) AS negative_recency,
  count(*) FILTER (WHERE transaction_count = 0 AND avg_amount_paid IS NULL) AS empty_windows,
  count(*) FILTER (WHERE transaction_count = 0 AND (avg_amount_paid IS NOT NULL OR auto_renew_rate IS NOT NULL
    OR cancellation_rate IS NOT NULL OR transaction_recency_days IS NOT NULL)) AS inconsistent_empty
FROM transaction_features""",
    ),
    "window_coverage": I.with_ctes(
        I.RAW_MEMBERS_SQL,
        "d AS (SELECT CAST(TRY_STRPTIME(registered, '%Y%m%d') AS DATE) AS r FROM raw_members)",
        select="""SELECT count(*) AS total_rows, count(*) FILTER (WHERE r IS NULL) AS invalid_registered,
  count(*) FILTER (WHERE r BETWEEN DATE '2000-01-01' AND DATE '2001-08-01') AS rows_in_window FROM d""",
    ),
    "auto_renew_counts": I.with_ctes(
        I.TRANSACTIONS_SQL,
        select="""SELECT is_auto_renew, is_cancel, count(*) AS records FROM transactions
WHERE transaction_date BETWEEN DATE '2001-01-01' AND DATE '2001-08-01' GROUP BY ALL""",
    ),
    "label_share": I.with_ctes(
        I.COHORT_SQL,
        select="""SELECT is_churn, count(*) AS customers,
  CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS DOUBLE) AS percentage FROM cohort GROUP BY is_churn""",
    ),
}
