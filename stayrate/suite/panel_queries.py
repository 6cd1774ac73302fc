"""Point-in-time panel over customers, orders and line items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators import pointintime as T
from stayrate.operators.joins import key_overlap
from stayrate.operators.splits import (
    chronological_split,
    label_counts_by_split,
    split_summary,
)
from stayrate.suite import inputs as I

ID = "c_custkey"
RANGES = {
    "train": (None, date(2000, 12, 31)),
    "validation": (date(2001, 1, 1), date(2001, 2, 28)),
    "test": (date(2001, 3, 1), date(2001, 6, 30)),
}


def barred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ineligible_keys(
        I.outcomes(spark, sf_dir), I.CALENDAR, ID, "cancelled", F.col("churn"), F.col("pending"), "returned"
    )


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.spine(I.population(spark, sf_dir), I.CALENDAR, "acquired")
    return T.add_ages(rows, {"tenure_days": "acquired"})


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.eligible_spine(spine(spark, sf_dir), barred(spark, sf_dir), ID)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.horizon_labels(I.outcomes(spark, sf_dir), I.CALENDAR, ID, "cancelled", 30, F.col("churn"))


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", ID)
    price = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_totalprice"))
    return T.lookback_features(
        orders,
        I.CALENDAR,
        ID,
        "o_orderdate",
        90,
        [
            F.count(F.lit(1)).alias("events_90d"),
            F.countDistinct("o_orderpriority").alias("kinds_90d"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("searches_90d"),
            F.avg(price).alias("mean_price_90d"),
        ],
        "days_since_event",
    )


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias(ID))
    lines = I.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    failed = F.col("l_returnflag") == "R"
    return T.lookback_features(
        lines,
        I.CALENDAR,
        ID,
        "l_shipdate",
        90,
        [
            F.count(F.lit(1)).alias("billing_events_90d"),
            T.total_or_zero("l_extendedprice").alias("amount_90d"),
            F.sum(failed.cast("int")).alias("failures_90d"),
            T.total_or_zero(F.when(failed, F.col("l_discount"))).alias("refunds_90d"),
        ],
        "days_since_billing",
    )


def panel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assemble(
        eligible(spark, sf_dir),
        [engagement(spark, sf_dir), billing(spark, sf_dir)],
        labels(spark, sf_dir),
        ID,
        "target",
        30,
        {"events_observed_90d": "events_90d", "billing_events_observed_90d": "billing_events_90d"},
    )


def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.rounded(panel_table(spark, sf_dir), ["amount_90d", "refunds_90d"], 4)
    return I.rounded(df, ["mean_price_90d"], 7)


def panel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir)


def labelled_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assemble(eligible(spark, sf_dir), [], labels(spark, sf_dir), ID, "target", 30, {})


def panel_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_date = T.prevalence_by_date(labelled_spine(spark, sf_dir), "target")
    return I.rounded(by_date, ["prevalence"], 9)


def latest_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last_dates(panel_prevalence(spark, sf_dir), 8)


def event_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookback over events within a day: fractional recency, distinct kinds, no zero fill."""
    df = T.lookback_features(
        I.table(spark, sf_dir, "events"),
        I.EVENT_CALENDAR,
        "user_id",
        "ts",
        30,
        [F.count(F.lit(1)).alias("events_30d"), F.countDistinct("event_type").alias("kinds_30d")],
        "days_since_last",
    )
    return I.rounded(df, ["days_since_last"], 9)


def split_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronological_split(labelled_spine(spark, sf_dir), "index_date", RANGES)


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_panel(spark, sf_dir).select(ID, "index_date", "split")


def chrono_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_summary(split_panel(spark, sf_dir), "split", ID, "target", "index_date")
    return I.rounded(df, ["prevalence_pct"], 9)


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("train", "validation"), ("validation", "test"), ("train", "test")]
    return key_overlap(split_panel(spark, sf_dir), ID, "split", pairs)


def target_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts_by_split(split_panel(spark, sf_dir), "split", "target")


QUERIES = {
    "panel_spine": spine,
    "panel_eligibility": eligible,
    "panel_barred": barred,
    "panel_labels": panel_labels,
    "panel_features": panel_features,
    "panel_prevalence": panel_prevalence,
    "panel_latest_prevalence": latest_prevalence,
    "event_recency": event_recency,
    "chrono_split": chrono_split,
    "chrono_summary": chrono_summary,
    "split_overlap": split_overlap,
    "target_by_split": target_by_split,
}

_TENURE = "date_diff('day', acquired, index_date)::DOUBLE AS tenure_days"
_LABELLED = I.PANEL_BASE_SQL + """,
labelled AS (
  SELECT e.c_custkey, e.index_date, CAST(p.c_custkey IS NOT NULL AS INTEGER) AS target
  FROM eligible e LEFT JOIN positives p ON e.c_custkey = p.c_custkey AND e.index_date = p.index_date),
split AS (
  SELECT *, CASE WHEN index_date <= TIMESTAMP '2000-12-31' THEN 'train'
    WHEN index_date BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-02-28' THEN 'validation'
    WHEN index_date BETWEEN TIMESTAMP '2001-03-01' AND TIMESTAMP '2001-06-30' THEN 'test' END AS split
  FROM labelled)"""
_BY_DATE = """SELECT index_date, count(*) AS rows, CAST(sum(target) AS BIGINT) AS positives,
  round(avg(target), 9) AS prevalence FROM labelled GROUP BY index_date"""

ORACLES = {
    "panel_spine": I.with_ctes(I.PANEL_BASE_SQL, select=f"SELECT *, {_TENURE} FROM spine"),
    "panel_eligibility": I.with_ctes(I.PANEL_BASE_SQL, select=f"SELECT *, {_TENURE} FROM eligible"),
    "panel_barred": I.with_ctes(I.PANEL_BASE_SQL, select="SELECT * FROM barred"),
    "panel_labels": I.with_ctes(I.PANEL_BASE_SQL, select="SELECT * FROM positives"),
    "panel_features": I.with_ctes(
        I.PANEL_BASE_SQL,
        I.PANEL_FEATURES_SQL,
        select="""SELECT e.*, date_diff('day', acquired, e.index_date)::DOUBLE AS tenure_days, events_90d, kinds_90d, searches_90d,
  round(mean_price_90d, 7) AS mean_price_90d,
  date_diff('day', last_event, e.index_date)::DOUBLE AS days_since_event,
  billing_events_90d, round(amount_90d, 4) AS amount_90d, failures_90d, round(refunds_90d, 4) AS refunds_90d,
  date_diff('day', last_billing, e.index_date)::DOUBLE AS days_since_billing,
  CAST(p.c_custkey IS NOT NULL AS INTEGER) AS target,
  e.index_date + INTERVAL 30 DAY AS label_window_end,
  CAST(events_90d IS NOT NULL AS INTEGER) AS events_observed_90d,
  CAST(billing_events_90d IS NOT NULL AS INTEGER) AS billing_events_observed_90d
FROM eligible e
LEFT JOIN engagement g ON e.c_custkey = g.c_custkey AND e.index_date = g.index_date
LEFT JOIN billing b ON e.c_custkey = b.c_custkey AND e.index_date = b.index_date
LEFT JOIN positives p ON e.c_custkey = p.c_custkey AND e.index_date = p.index_date""",
    ),
    "panel_prevalence": I.with_ctes(_LABELLED, select=_BY_DATE),
    "panel_latest_prevalence": I.with_ctes(_LABELLED, select=f"{_BY_DATE} ORDER BY index_date DESC LIMIT 8"),
    "event_recency": """WITH idx AS (
  SELECT CAST(last_day(m) AS TIMESTAMP) AS index_date
  FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 MONTH)) AS m))
SELECT user_id, index_date, count(*) AS events_30d, count(DISTINCT event_type) AS kinds_30d,
  round(date_diff('microsecond', max(ts), index_date) / 86400000000.0::DOUBLE, 9) AS days_since_last
FROM events JOIN idx ON ts > index_date - INTERVAL 30 DAY AND ts <= index_date GROUP BY user_id, index_date""",
    "chrono_split": I.with_ctes(_LABELLED, select="SELECT c_custkey, index_date, split FROM split"),
    "chrono_summary": I.with_ctes(
        _LABELLED,
        select="""SELECT split, count(*) AS rows, count(DISTINCT c_custkey) AS entities,
  CAST(sum(target) AS BIGINT) AS positives, min(index_date) AS start_date, max(index_date) AS end_date,
  round(100.0::DOUBLE * sum(target) / count(*), 9) AS prevalence_pct FROM split GROUP BY split""",
    ),
    "split_overlap": I.with_ctes(
        _LABELLED,
        "k AS (SELECT DISTINCT c_custkey, split FROM split)",
        "pairs AS (SELECT * FROM (VALUES ('train', 'validation'), ('validation', 'test'), ('train', 'test')) v(left_part, right_part))",
        select="""SELECT left_part, right_part, count(b.c_custkey) AS shared FROM pairs
LEFT JOIN k a ON a.split = left_part LEFT JOIN k b ON b.split = right_part AND a.c_custkey = b.c_custkey
GROUP BY ALL""",
    ),
    "target_by_split": I.with_ctes(
        _LABELLED,
        select="""SELECT target, count(*) FILTER (WHERE split = 'train') AS train,
  count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test
FROM split GROUP BY target""",
    ),
}
