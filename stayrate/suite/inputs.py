"""Roles the test tables play, in Spark and as SQL for the check.

Each role is derived from whole tables; the SQL twin is a CTE body.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.calendar import IndexCalendar
from stayrate.operators.windows import Period, TransactionColumns

PERIODS = (
    Period("M1", date(2024, 1, 21), date(2024, 1, 31)),
    Period("M2", date(2024, 1, 11), date(2024, 1, 21)),
    Period("M3", date(2024, 1, 1), date(2024, 1, 11)),
)
WINDOW_START, WINDOW_END = date(2001, 1, 1), date(2001, 8, 1)
EARLIEST = date(2000, 1, 1)
# Every month-end with a full lookback before it and a full horizon after it.
CALENDAR = IndexCalendar(date(1995, 4, 30), date(2001, 6, 30))
EVENT_CALENDAR = IndexCalendar(date(2024, 1, 31), date(2024, 3, 31))

TRANSACTION_NAMES = TransactionColumns(
    id="c_custkey",
    date="transaction_date",
    paid="amount_paid",
    list_price="list_price",
    plan_days="plan_days",
    auto_renew="is_auto_renew",
    cancel="is_cancel",
    expiry="expiry",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_ctes(*parts: str, select: str) -> str:
    """One statement from CTE bodies and a final select."""
    return "WITH " + ",\n".join(parts) + "\n" + select


COHORT_SQL = "cohort AS (SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS is_churn FROM customer)"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("is_churn")
    )


ACTIVITY_SQL = """activity AS (
  SELECT user_id AS c_custkey, ts, value AS total_secs, length(event_type) AS total_num_unq,
         CAST(event_type = 'click' AS INTEGER) + CAST(event_type = 'view' AS INTEGER)
           + CAST(event_type = 'purchase' AS INTEGER) AS total_song_events
  FROM events)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(F.col("event_type") == k).cast("int") for k in ("click", "view", "purchase")]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("c_custkey"),
        "ts",
        F.col("value").alias("total_secs"),
        F.length("event_type").alias("total_num_unq"),
        (kinds[0] + kinds[1] + kinds[2]).alias("total_song_events"),
    )


TRANSACTIONS_SQL = """transactions AS (
  SELECT o_custkey AS c_custkey, CAST(o_orderdate AS DATE) AS transaction_date,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END AS amount_paid,
         o_totalprice + 10 AS list_price,
         CAST(o_orderkey % 90 AS INTEGER) AS plan_days,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              ELSE CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) END AS is_auto_renew,
         CAST(o_orderstatus = 'F' AS INTEGER) AS is_cancel,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN DATE '1970-01-01'
              ELSE CAST(o_orderdate AS DATE) + 30 END AS expiry
  FROM orders)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        day.alias("transaction_date"),
        F.when(priority != "3-MEDIUM", F.col("o_totalprice")).alias("amount_paid"),
        (F.col("o_totalprice") + 10).alias("list_price"),
        (F.col("o_orderkey") % 90).cast("int").alias("plan_days"),
        F.when(priority != "5-LOW", priority.isin("1-URGENT", "2-HIGH").cast("int")).alias("is_auto_renew"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_cancel"),
        F.when(priority == "4-NOT SPECIFIED", F.lit(date(1970, 1, 1)))
        .otherwise(F.date_add(day, 30))
        .alias("expiry"),
    )


# Coded dates: the same transactions with dates as yyyymmdd numbers.
CODED_SQL = TRANSACTIONS_SQL + """,
coded AS (
  SELECT c_custkey, is_cancel,
         CAST(strftime(transaction_date, '%Y%m%d') AS INTEGER) AS happened,
         CAST(strftime(expiry, '%Y%m%d') AS INTEGER) AS expires
  FROM transactions)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select(
        "c_custkey",
        "is_cancel",
        F.date_format("transaction_date", "yyyyMMdd").cast("int").alias("happened"),
        F.date_format("expiry", "yyyyMMdd").cast("int").alias("expires"),
    )


# Members with raw text: padded and blank gender, ages with decimals, impossible dates.
RAW_MEMBERS_SQL = """raw_members AS (
  SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS city,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '   ' ELSE concat(' ', c_mktsegment, '  ') END AS gender,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN 'unknown'
              ELSE concat(' ', CAST(CAST(floor(c_acctbal / 80) AS INTEGER) AS VARCHAR)) END AS age_text,
         CAST(20000100 + c_custkey % 1350 AS VARCHAR) AS registered
  FROM customer)"""

MEMBERS_SQL = RAW_MEMBERS_SQL + """,
members AS (
  SELECT c_custkey, TRY_CAST(city AS INTEGER) AS city, NULLIF(TRIM(gender), '') AS gender,
         CASE WHEN TRY_CAST(age_text AS INTEGER) BETWEEN 5 AND 99
              THEN TRY_CAST(age_text AS INTEGER) END AS age,
         CAST(year(CAST(TRY_STRPTIME(registered, '%Y%m%d') AS DATE)) AS INTEGER) AS registration_year,
         CAST(month(CAST(TRY_STRPTIME(registered, '%Y%m%d') AS DATE)) AS INTEGER) AS registration_month
  FROM raw_members)"""


def raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    age = F.floor(F.col("c_acctbal") / 80).cast("int").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_nationkey").cast("string").alias("city"),
        F.when(segment == "MACHINERY", "   ")
        .otherwise(F.concat(F.lit(" "), segment, F.lit("  ")))
        .alias("gender"),
        F.when(segment == "FURNITURE", "unknown").otherwise(F.concat(F.lit(" "), age)).alias("age_text"),
        (F.lit(20000100) + F.col("c_custkey") % 1350).cast("string").alias("registered"),
    )


# Scored set over all orders: two models whose scores tie often.
SCORED_SQL = """scored AS (
  SELECT o_orderkey AS id, o_custkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
         CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000.0::DOUBLE AS p,
         (CAST(floor(o_totalprice) AS BIGINT) % 773 + 100 * CAST(o_orderstatus = 'F' AS INTEGER)) / 1000.0::DOUBLE AS p2
  FROM orders),
classed AS (
  SELECT id, o_custkey, y, p, p2, CAST(p >= 0.6 AS INTEGER) AS yhat, CAST(p2 >= 0.5 AS INTEGER) AS yhat2
  FROM scored)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("o_totalprice").cast("bigint")
    y = (F.col("o_orderstatus") == "F").cast("int")
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("id"),
            "o_custkey",
            y.alias("y"),
            (price % 1000 / F.lit(1000.0)).alias("p"),
            ((price % 773 + 100 * y) / F.lit(1000.0)).alias("p2"),
        )
        .withColumns(
            {
                "yhat": (F.col("p") >= 0.6).cast("int"),
                "yhat2": (F.col("p2") >= 0.5).cast("int"),
            }
        )
    )


def scored_pair(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "y",
        F.col("p").alias("p_a"),
        F.col("yhat").alias("yhat_a"),
        F.col("p2").alias("p_b"),
        F.col("yhat2").alias("yhat_b"),
    )


# Training table: gaps, rare and missing categories in labelled documents.
TRAINING_SQL = """training AS (
  SELECT l.doc_id, l.quality,
         CASE WHEN d.lang = 'es' THEN NULL ELSE CAST(d.n_chars AS DOUBLE) END AS n_chars,
         CAST(l.toxic AS DOUBLE) AS toxic,
         CAST(length(d.source) AS DOUBLE) AS source_length,
         CASE WHEN d.n_chars > 30000 THEN 'long' WHEN d.lang = 'fr' THEN NULL ELSE d.lang END AS lang,
         CASE WHEN l.toxic = 1 AND d.lang = 'de' AND l.quality = 0 THEN 'only-here' ELSE d.source END AS source
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, sf_dir, "labels").join(documents, "doc_id")
    rare = (F.col("toxic") == 1) & (F.col("lang") == "de") & (F.col("quality") == 0)
    return joined.select(
        "doc_id",
        "quality",
        F.when(F.col("lang") != "es", F.col("n_chars").cast("double")).alias("n_chars"),
        F.col("toxic").cast("double").alias("toxic"),
        F.length("source").cast("double").alias("source_length"),
        F.when(F.col("n_chars") > 30000, "long")
        .when(F.col("lang") != "fr", F.col("lang"))
        .alias("lang"),
        F.when(rare, "only-here").otherwise(F.col("source")).alias("source"),
    )


# Panel over customers: orders are outcomes and engagement, line items are billing.
PANEL_DATES_SQL = """idx AS (
  SELECT CAST(last_day(m) AS TIMESTAMP) AS index_date
  FROM (SELECT unnest(generate_series(DATE '1995-04-01', DATE '2001-06-01', INTERVAL 1 MONTH)) AS m))"""

PANEL_BASE_SQL = PANEL_DATES_SQL + """,
population AS (
  SELECT c_custkey, c_mktsegment, min(o_orderdate) AS acquired
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
outcomes AS (
  SELECT o_custkey AS c_custkey, o_orderdate AS cancelled,
         o_orderstatus = 'F' AND o_totalprice > 480000 AS churn,
         o_orderstatus = 'P' AND o_totalprice > 400000 AS pending,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate + INTERVAL 45 DAY END AS returned
  FROM orders),
barred AS (
  SELECT DISTINCT c_custkey, index_date FROM outcomes JOIN idx ON cancelled <= index_date
  WHERE churn OR (pending AND (returned IS NULL OR returned > index_date))),
spine AS (
  SELECT p.*, index_date FROM population p JOIN idx ON acquired <= index_date),
eligible AS (
  SELECT s.* FROM spine s WHERE NOT EXISTS (
    SELECT 1 FROM barred b WHERE b.c_custkey = s.c_custkey AND b.index_date = s.index_date)),
positives AS (
  SELECT DISTINCT c_custkey, index_date FROM outcomes JOIN idx
    ON cancelled > index_date AND cancelled <= index_date + INTERVAL 30 DAY
  WHERE churn)"""

PANEL_FEATURES_SQL = """engagement AS (
  SELECT o_custkey AS c_custkey, index_date, count(*) AS events_90d,
         count(DISTINCT o_orderpriority) AS kinds_90d,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS searches_90d,
         avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END) AS mean_price_90d,
         max(o_orderdate) AS last_event
  FROM orders JOIN idx ON o_orderdate > index_date - INTERVAL 90 DAY AND o_orderdate <= index_date
  GROUP BY ALL),
billing AS (
  SELECT o_custkey AS c_custkey, index_date, count(*) AS billing_events_90d,
         sum(l_extendedprice) AS amount_90d,
         CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS failures_90d,
         coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_discount END), 0) AS refunds_90d,
         max(l_shipdate) AS last_billing
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN idx ON l_shipdate > index_date - INTERVAL 90 DAY AND l_shipdate <= index_date
  GROUP BY ALL)"""


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("acquired"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(first, "c_custkey", "left")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderdate").alias("cancelled"),
        ((status == "F") & (price > 480000)).alias("churn"),
        ((status == "P") & (price > 400000)).alias("pending"),
        F.when(
            F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")
        ).alias("returned"),
    )
