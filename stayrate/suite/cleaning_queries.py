"""Parsing and normalising messy text derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions import cleaning as C
from stayrate.functions.calendar import elapsed_days
from stayrate.suite import inputs as I


def category_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities with odd spacing and casing, and blanks."""
    priority = F.col("o_orderpriority")
    messy = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("  "), F.lower(priority), F.lit("\t at-risk ")))
        .when(priority == "3-MEDIUM", F.lit(" \t "))
        .otherwise(F.concat(priority, F.lit("   rOW one")))
    )
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey", C.normalise_category(messy).alias("category")
    )


def safe_parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as whole, decimal, padded or broken text."""
    balance = F.col("c_acctbal")
    whole = F.floor(balance).cast("bigint").cast("string")
    text = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit(" "), whole, F.lit(" ")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(whole, F.lit("x")))
        .when(F.col("c_mktsegment") == "BUILDING", F.lit(""))
        .otherwise(balance.cast("decimal(12,2)").cast("string"))
    )
    return I.table(spark, sf_dir, "customer").select(
        "c_custkey",
        C.tolerant_double(text).alias("as_double"),
        C.tolerant_int(text).alias("as_int"),
        C.tolerant_long(text).alias("as_long"),
        C.keep_between(C.tolerant_int(text), 5, 99).alias("in_range"),
        C.is_observed(C.tolerant_int(text)).alias("observed"),
    )


def safe_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded dates that may not exist, with their parts."""
    parsed = C.parse_yyyymmdd("registered")
    return I.raw_members(spark, sf_dir).select(
        "c_custkey", parsed.alias("day"), F.year(parsed).alias("year"), F.month(parsed).alias("month")
    )


def safe_parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text in two formats, some cut short."""
    full = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = (
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy/MM/dd HH:mm"))
        .when(F.col("event_type") == "error", F.substring(full, 1, 12))
        .otherwise(full)
    )
    parsed = C.parse_timestamp(text, ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm"])
    return I.table(spark, sf_dir, "events").select("event_id", parsed.alias("parsed"))


def boolean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click indicator text, blank unless the event is a click or a view."""
    text = (
        F.when(F.col("event_type") == "click", " True ")
        .when(F.col("event_type") == "view", "FALSE")
        .otherwise("")
    )
    return I.table(spark, sf_dir, "events").select("event_id", C.boolean_text(text).alias("clicked"))


def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and infinities become NULL; categories become text."""
    balance = F.col("c_acctbal")
    odd = (
        F.when(balance < 0, float("nan"))
        .when(balance > 9000, float("inf"))
        .otherwise(balance)
    )
    return I.table(spark, sf_dir, "customer").select(
        "c_custkey",
        C.finite_or_null(odd).alias("finite"),
        C.category_text(F.when(F.col("c_nationkey") != 7, F.col("c_nationkey"))).alias("nation"),
        C.safe_ratio("c_acctbal", F.col("c_nationkey") % 3).cast("decimal(18,4)").cast("double").alias("ratio"),
    )


def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional days from each event to the end of its month."""
    month_end = F.last_day("ts").cast("timestamp_ntz")
    return I.table(spark, sf_dir, "events").select(
        "event_id", F.round(elapsed_days(month_end, "ts"), 9).alias("days")
    )


def thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scored(spark, sf_dir).select("id", C.at_threshold("p2", 0.25).alias("yhat"))


QUERIES = {
    "category_normalise": category_normalise,
    "safe_parse_numbers": safe_parse_numbers,
    "safe_parse_dates": safe_parse_dates,
    "safe_parse_timestamps": safe_parse_timestamps,
    "boolean_flags": boolean_flags,
    "finite_values": finite_values,
    "elapsed_days": elapsed,
    "thresholded": thresholded,
}

ORACLES = {
    "category_normalise": r"""WITH m AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN concat('  ', lower(o_orderpriority), chr(9), ' at-risk ')
    WHEN o_orderpriority = '3-MEDIUM' THEN concat(' ', chr(9), ' ')
    ELSE concat(o_orderpriority, '   rOW one') END AS v FROM orders),
s AS (SELECT o_orderkey, trim(regexp_replace(v, '\s+', ' ', 'g')) AS v FROM m)
SELECT o_orderkey, NULLIF(array_to_string([
    CASE WHEN i = 1 OR NOT regexp_matches(substr(v, i - 1, 1), '[A-Za-z]')
         THEN upper(substr(v, i, 1)) ELSE lower(substr(v, i, 1)) END
    for i in range(1, length(v) + 1)], ''), '') AS category FROM s""",
    "safe_parse_numbers": """WITH t AS (
  SELECT c_custkey, CASE c_mktsegment
    WHEN 'MACHINERY' THEN concat(' ', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), ' ')
    WHEN 'FURNITURE' THEN concat(CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), 'x')
    WHEN 'BUILDING' THEN ''
    ELSE CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END AS v FROM customer),
n AS (SELECT c_custkey, TRY_CAST(v AS DOUBLE) AS d, CAST(round(TRY_CAST(v AS DOUBLE)) AS INTEGER) AS i FROM t)
SELECT c_custkey, d AS as_double, i AS as_int, CAST(i AS BIGINT) AS as_long,
  CASE WHEN i BETWEEN 5 AND 99 THEN i END AS in_range, CAST(i IS NOT NULL AS INTEGER) AS observed FROM n""",
    "safe_parse_dates": I.with_ctes(
        I.RAW_MEMBERS_SQL,
        "d AS (SELECT c_custkey, CAST(TRY_STRPTIME(registered, '%Y%m%d') AS DATE) AS day FROM raw_members)",
        select="SELECT c_custkey, day, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month FROM d",
    ),
    "safe_parse_timestamps": """SELECT event_id, CASE event_type
    WHEN 'click' THEN date_trunc('minute', ts) WHEN 'error' THEN NULL ELSE date_trunc('second', ts) END AS parsed
FROM events""",
    "boolean_flags": """SELECT event_id,
  CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE END AS clicked FROM events""",
    "finite_values": """SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END AS finite,
  coalesce(CAST(NULLIF(c_nationkey, 7) AS VARCHAR), '__MISSING__') AS nation,
  CAST(CAST(c_acctbal / NULLIF(c_nationkey % 3, 0) AS DECIMAL(18, 4)) AS DOUBLE) AS ratio FROM customer""",
    "elapsed_days": """SELECT event_id,
  round(date_diff('microsecond', ts, CAST(last_day(ts) AS TIMESTAMP)) / 86400000000.0::DOUBLE, 9) AS days FROM events""",
    "thresholded": I.with_ctes(I.SCORED_SQL, select="SELECT id, CAST(p2 >= 0.25 AS INTEGER) AS yhat FROM scored"),
}
