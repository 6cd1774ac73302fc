"""Profiles and audits of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.cleaning import outside
from stayrate.operators import profile as P
from stayrate.operators.joins import (
    coverage,
    drop_exact_duplicates,
    key_union,
    keys_without,
    membership_flag,
    orphan_count,
)
from stayrate.operators.ordering import exact_quantiles
from stayrate.suite import inputs as I

EARLIEST_CODE = 20000101
MONTH_CODES = (20010201, 20010228)


def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.row_profile(I.table(spark, sf_dir, "events"), "user_id")


def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranges(I.coded(spark, sf_dir), ["happened", "expires"])


def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(I.cohort(spark, sf_dir), I.activity(spark, sf_dir), "c_custkey")


def activity_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership_flag(
        I.cohort(spark, sf_dir), I.activity(spark, sf_dir), "c_custkey", "has_activity"
    )


def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_timeline(
        I.cohort(spark, sf_dir), I.coded(spark, sf_dir), "c_custkey", "is_churn", "happened", "expires"
    )


def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entity_timeline(
        I.cohort(spark, sf_dir), I.coded(spark, sf_dir), "c_custkey", "happened", "expires"
    )


def last_valid_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_last_valid(
        I.cohort(spark, sf_dir), I.coded(spark, sf_dir), "c_custkey", "is_churn", "expires", EARLIEST_CODE
    )


def last_valid_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.last_valid_distribution(
        I.cohort(spark, sf_dir), I.coded(spark, sf_dir), "c_custkey", "expires", EARLIEST_CODE
    )


def semi_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labels_of_members(
        I.cohort(spark, sf_dir),
        I.coded(spark, sf_dir),
        "c_custkey",
        "is_churn",
        F.col("expires").between(*MONTH_CODES),
    )


def anomaly_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anomaly_report(
        I.coded(spark, sf_dir),
        I.cohort(spark, sf_dir).where("is_churn = 1"),
        "c_custkey",
        F.col("expires") < EARLIEST_CODE,
    )


def anomaly_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anomaly_report(
        I.coded(spark, sf_dir),
        I.cohort(spark, sf_dir).where("is_churn = 1"),
        "c_custkey",
        F.col("expires") < EARLIEST_CODE,
        ["is_cancel"],
    )


def expiry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.expiry_quality(I.coded(spark, sf_dir), "expires", EARLIEST_CODE)


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.null_profile(I.transactions(spark, sf_dir)).drop("column_type")


def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["customer", "orders", "lineitem", "events", "nation"]
    ids = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}
    return P.table_inventory({n: I.table(spark, sf_dir, n) for n in names}, ids)


def duplicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return P.duplicate_profile(lines, ["l_orderkey", "l_linenumber"], "l_orderkey")


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return drop_exact_duplicates(lines)


def date_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.date_quality(I.outcomes(spark, sf_dir), ["cancelled", "returned"])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user is no customer in debt (few are, so most are orphans)."""
    debtors = I.cohort(spark, sf_dir).where("is_churn = 1")
    return orphan_count(I.table(spark, sf_dir, "events"), "user_id", debtors, "c_custkey")


def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys_without(I.cohort(spark, sf_dir), I.activity(spark, sf_dir), "c_custkey")


def united_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    indebted = I.cohort(spark, sf_dir).where("is_churn = 1").select("c_custkey")
    return key_union([indebted, I.activity(spark, sf_dir).select("c_custkey")])


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_values(I.table(spark, sf_dir, "customer"), "c_nationkey", 20)


def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distribution(I.transactions(spark, sf_dir), ["is_auto_renew"])


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = I.transactions(spark, sf_dir).join(I.cohort(spark, sf_dir), "c_custkey")
    return P.crosstab(facts, "is_auto_renew", "is_cancel", [0, 1])


def crosstab_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses by priority, of which only two are named."""
    orders = I.table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    return P.crosstab(orders.withColumn("priority", priority), "o_orderstatus", "priority", ["1-URGENT", "5-LOW"])


def monthly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.monthly_counts(
        {
            "orders": (I.table(spark, sf_dir, "orders"), "o_orderdate"),
            "lineitem": (I.table(spark, sf_dir, "lineitem"), "l_shipdate"),
            "events": (I.table(spark, sf_dir, "events"), "ts"),
        }
    )


def box_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.box_summary(I.table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus")
    return I.rounded(df, ["q1", "median", "q3"], 7)


def group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = exact_quantiles(
        I.table(spark, sf_dir, "lineitem"),
        "l_extendedprice",
        {"low": 0.025, "high": 0.975},
        ["l_returnflag"],
    )
    return I.rounded(df, ["low", "high"], 7)


def anomaly_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = I.coded(spark, sf_dir)
    return P.counters(
        coded,
        {
            "outside": outside("happened", 19960101, 20001231),
            "contradiction": F.col("is_cancel").isin(1) & (F.col("expires") < EARLIEST_CODE),
            "missing": F.col("expires").isNull(),
        },
    )


def approximate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, and whether the sketch is within five standard errors."""
    orders = I.table(spark, sf_dir, "orders")
    names = ["o_orderkey", "o_custkey"]
    sketched = P.approximate_distinct(orders, names, 0.02).unpivot([], names, "column_name", "approx")
    exact = orders.agg(*[F.countDistinct(n).alias(n) for n in names])
    exact = exact.unpivot([], names, "column_name", "distinct_values")
    close = F.abs(F.col("approx") - F.col("distinct_values")) <= 0.1 * F.col("distinct_values")
    return exact.join(sketched, "column_name").select("column_name", "distinct_values", close.alias("close"))


QUERIES = {
    "row_profile": row_profile,
    "column_ranges": column_ranges,
    "coverage": event_coverage,
    "activity_flag": activity_flag,
    "timeline_summary": timeline_summary,
    "entity_timeline": entity_timeline,
    "last_valid_date": last_valid_date,
    "last_valid_distribution": last_valid_distribution,
    "semi_label_counts": semi_label_counts,
    "anomaly_total": anomaly_total,
    "anomaly_by_status": anomaly_by_status,
    "expiry_quality": expiry_quality,
    "null_profile": null_profile,
    "table_inventory": table_inventory,
    "duplicate_profile": duplicate_profile,
    "distinct_rows": distinct_rows,
    "date_quality": date_quality,
    "orphans": orphans,
    "unknown_keys": unknown_keys,
    "united_keys": united_keys,
    "top_values": top_values,
    "value_distribution": value_distribution,
    "crosstab": crosstab,
    "crosstab_open": crosstab_open,
    "monthly_coverage": monthly_coverage,
    "box_summary": box_summary,
    "group_quantiles": group_quantiles,
    "anomaly_counters": anomaly_counters,
    "approximate_ids": approximate_ids,
}

_NULLS = ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}"
    for c in (
        "c_custkey",
        "transaction_date",
        "amount_paid",
        "list_price",
        "plan_days",
        "is_auto_renew",
        "is_cancel",
        "expiry",
    )
)

_LAST_VALID = """last_valid AS (
  SELECT c_custkey, max(expires) AS last_valid FROM coded WHERE expires >= 20000101 GROUP BY c_custkey)"""

ORACLES = {
    "row_profile": """SELECT count(*) AS rows, count(DISTINCT user_id) AS distinct_ids,
  count(*) FILTER (WHERE user_id IS NULL) AS null_ids FROM events""",
    "column_ranges": I.with_ctes(
        I.CODED_SQL,
        select="""SELECT min(happened) AS min_happened, max(happened) AS max_happened,
  min(expires) AS min_expires, max(expires) AS max_expires FROM coded""",
    ),
    "coverage": """WITH c AS (SELECT DISTINCT c_custkey FROM customer), e AS (SELECT DISTINCT user_id FROM events)
SELECT count(*) AS entities, count(user_id) AS with_facts, count(*) - count(user_id) AS without_facts,
  CAST(round(100.0 * count(user_id) / count(*), 2) AS DOUBLE) AS pct_with_facts
FROM c LEFT JOIN e ON c_custkey = user_id""",
    "activity_flag": I.with_ctes(
        I.COHORT_SQL,
        select="""SELECT c_custkey, is_churn,
  CAST(c_custkey IN (SELECT user_id FROM events) AS INTEGER) AS has_activity FROM cohort""",
    ),
    "timeline_summary": I.with_ctes(
        I.COHORT_SQL,
        I.CODED_SQL,
        """t AS (SELECT c.c_custkey, c.is_churn, max(happened) AS last_when, max(expires) AS last_expiry
  FROM cohort c JOIN coded x ON c.c_custkey = x.c_custkey GROUP BY ALL)""",
        select="""SELECT is_churn, count(*) AS entities, min(last_when) AS min_last_when,
  max(last_when) AS max_last_when, min(last_expiry) AS min_last_expiry, max(last_expiry) AS max_last_expiry
FROM t GROUP BY is_churn""",
    ),
    "entity_timeline": I.with_ctes(
        I.COHORT_SQL,
        I.CODED_SQL,
        select="""SELECT c.c_custkey, c.is_churn, min(happened) AS first_when, max(happened) AS last_when,
  min(expires) AS first_expiry, max(expires) AS last_expiry, count(*) AS facts
FROM cohort c JOIN coded x ON c.c_custkey = x.c_custkey GROUP BY c.c_custkey, c.is_churn""",
    ),
    "last_valid_date": I.with_ctes(
        I.COHORT_SQL,
        I.CODED_SQL,
        _LAST_VALID,
        select="""SELECT is_churn, count(*) AS entities, min(last_valid) AS min_last_valid,
  max(last_valid) AS max_last_valid FROM cohort JOIN last_valid USING (c_custkey) GROUP BY is_churn""",
    ),
    "last_valid_distribution": I.with_ctes(
        I.COHORT_SQL,
        I.CODED_SQL,
        _LAST_VALID,
        select="""SELECT last_valid, count(*) AS entities
FROM cohort JOIN last_valid USING (c_custkey) GROUP BY last_valid""",
    ),
    "semi_label_counts": I.with_ctes(
        I.COHORT_SQL,
        I.CODED_SQL,
        "hit AS (SELECT DISTINCT c_custkey FROM coded WHERE expires BETWEEN 20010201 AND 20010228)",
        select="SELECT is_churn, count(*) AS entities FROM cohort JOIN hit USING (c_custkey) GROUP BY is_churn",
    ),
    "anomaly_total": I.with_ctes(
        I.COHORT_SQL,
        I.CODED_SQL,
        select="""SELECT count(*) AS records, count(DISTINCT t.c_custkey) AS entities,
  count(DISTINCT c.c_custkey) AS labelled_entities
FROM coded t LEFT JOIN (SELECT * FROM cohort WHERE is_churn = 1) c ON t.c_custkey = c.c_custkey
WHERE expires < 20000101""",
    ),
    "anomaly_by_status": I.with_ctes(
        I.COHORT_SQL,
        I.CODED_SQL,
        select="""SELECT is_cancel, count(*) AS records, count(DISTINCT t.c_custkey) AS entities,
  count(DISTINCT CASE WHEN c.c_custkey IS NOT NULL THEN t.c_custkey END) AS labelled_entities
FROM coded t LEFT JOIN (SELECT * FROM cohort WHERE is_churn = 1) c ON t.c_custkey = c.c_custkey
WHERE expires < 20000101 GROUP BY is_cancel""",
    ),
    "expiry_quality": I.with_ctes(
        I.CODED_SQL,
        select="""SELECT count(*) AS records,
  CAST(sum(CASE WHEN expires < 20000101 THEN 1 ELSE 0 END) AS BIGINT) AS suspicious,
  min(expires) AS min_value, max(expires) AS max_value FROM coded""",
    ),
    "null_profile": I.with_ctes(
        I.TRANSACTIONS_SQL,
        f"n AS (SELECT {_NULLS} FROM transactions)",
        select="""SELECT column_name, missing,
  CAST(round(100.0 * missing / (SELECT count(*) FROM transactions), 2) AS DOUBLE) AS missing_pct
FROM (UNPIVOT n ON * INTO NAME column_name VALUE missing)""",
    ),
    "table_inventory": """
SELECT 'customer' AS table_name, count(*) AS rows, 5 AS columns, count(DISTINCT c_custkey) AS distinct_ids FROM customer
UNION ALL SELECT 'orders', count(*), 6, count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'lineitem', count(*), 11, NULL FROM lineitem
UNION ALL SELECT 'events', count(*), 6, count(DISTINCT user_id) FROM events
UNION ALL SELECT 'nation', count(*), 3, NULL FROM nation""",
    "duplicate_profile": """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem)
SELECT (SELECT count(*) FROM l) AS rows,
  (SELECT count(*) FROM l) - (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS duplicate_rows,
  (SELECT count(*) FROM l) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM l)) AS duplicate_keys,
  (SELECT count(*) FROM l WHERE l_orderkey IS NULL) AS missing_ids""",
    "distinct_rows": "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem",
    "date_quality": I.with_ctes(
        """o AS (SELECT o_orderdate AS cancelled,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate + INTERVAL 45 DAY END AS returned FROM orders)""",
        select="""SELECT 'cancelled' AS column_name, count(cancelled) AS parsed, count(*) AS total,
  min(cancelled) AS earliest, max(cancelled) AS latest FROM o
UNION ALL SELECT 'returned', count(returned), count(*), min(returned), max(returned) FROM o""",
    ),
    "orphans": """SELECT count(*) AS unmatched_rows, count(DISTINCT user_id) AS unmatched_keys FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "unknown_keys": "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "united_keys": "SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT user_id FROM events",
    "top_values": """SELECT c_nationkey, count(*) AS records FROM customer GROUP BY c_nationkey
ORDER BY records DESC, c_nationkey LIMIT 20""",
    "value_distribution": I.with_ctes(
        I.TRANSACTIONS_SQL,
        select="SELECT is_auto_renew, count(*) AS records FROM transactions GROUP BY is_auto_renew",
    ),
    "crosstab": I.with_ctes(
        I.TRANSACTIONS_SQL,
        select="""SELECT coalesce(CAST(is_auto_renew AS VARCHAR), 'missing') AS is_auto_renew,
  count(*) FILTER (WHERE is_cancel = 0) AS "0", count(*) FILTER (WHERE is_cancel = 1) AS "1",
  count(*) FILTER (WHERE is_cancel IS NULL) AS missing,
  count(*) FILTER (WHERE is_cancel NOT IN (0, 1)) AS other
FROM transactions JOIN customer USING (c_custkey) GROUP BY 1""",
    ),
    "crosstab_open": """SELECT o_orderstatus,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW",
  count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS missing,
  count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW', '3-MEDIUM')) AS other
FROM orders GROUP BY o_orderstatus""",
    "monthly_coverage": """
SELECT 'orders' AS source, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS records FROM orders GROUP BY ALL
UNION ALL SELECT 'lineitem', CAST(date_trunc('month', l_shipdate) AS DATE), count(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'events', CAST(date_trunc('month', ts) AS DATE), count(*) FROM events GROUP BY ALL""",
    "box_summary": """WITH q AS (
  SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
         quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY o_orderstatus)
SELECT q.o_orderstatus, round(q1, 7) AS q1, round(median, 7) AS median, round(q3, 7) AS q3, count(*) AS n,
  min(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS whisker_low,
  max(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS whisker_high
FROM orders o JOIN q ON o.o_orderstatus = q.o_orderstatus GROUP BY ALL""",
    "group_quantiles": """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 7) AS low,
  round(quantile_cont(l_extendedprice, 0.975), 7) AS high FROM lineitem GROUP BY l_returnflag""",
    "approximate_ids": """SELECT 'o_orderkey' AS column_name, count(DISTINCT o_orderkey) AS distinct_values, TRUE AS close FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), TRUE FROM orders""",
    "anomaly_counters": I.with_ctes(
        I.CODED_SQL,
        """c AS (SELECT count(*) FILTER (WHERE happened < 19960101 OR happened > 20001231) AS outside,
    count(*) FILTER (WHERE is_cancel = 1 AND expires < 20000101) AS contradiction,
    count(*) FILTER (WHERE expires IS NULL) AS missing FROM coded)""",
        select="SELECT check_name, rows_found FROM (UNPIVOT c ON * INTO NAME check_name VALUE rows_found)",
    ),
}
