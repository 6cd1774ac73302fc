"""Key audits, membership, alignment, salted joins and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators import joins as J
from stayrate.operators.explain import mean_abs_contribution, top_contributions
from stayrate.operators.metrics import class_metrics
from stayrate.operators.models import Candidate, candidate_table, fit_prior, score_prior
from stayrate.operators.quality import key_report
from stayrate.suite import inputs as I
from stayrate.suite import metric_queries as MQ

# Slopes of an imagined linear model over the line item's measures.
SLOPES = {"l_quantity": 0.02, "l_discount": -3.0, "l_tax": 5.0}


def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_report(I.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def members_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers in debt."""
    orders = I.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.members_only(orders, I.cohort(spark, sf_dir).where("is_churn = 1"), "c_custkey")


def non_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any event."""
    return J.non_members(I.cohort(spark, sf_dir), I.activity(spark, sf_dir), "c_custkey")


def aligned_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored sets side by side after the alignment gates."""
    df = I.scored(spark, sf_dir)
    parts = [
        df.select("id", F.col("y").alias("actual"), F.col(p).alias("probability"), F.col(c).alias("prediction"))
        for p, c in (("p", "yhat"), ("p2", "yhat2"))
    ]
    return J.align_scored(*parts)


def salted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events joined to customers with every key above a thousandth of the rows salted."""
    events = I.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c_custkey"))
    customers = I.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return J.salted_join(events, customers, "c_custkey", salts=4, min_rows=0)


def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their order totals, uniqueness checked on both sides."""
    totals = (
        I.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return J.left_one_to_one(I.cohort(spark, sf_dir), totals, "c_custkey", "order totals")


def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored candidates and the prior ranked by average precision."""
    df = I.scored(spark, sf_dir)
    prior = score_prior(fit_prior(df, "y"), df, [], "y")
    candidates = [
        Candidate("first", None, df.select("y", "p")),
        Candidate("second", None, df.select("y", F.col("p2").alias("p"))),
        Candidate("prior", None, prior),
    ]
    ranked = candidate_table(candidates)
    return I.rounded(ranked, ["average_precision", "roc_auc", "brier", "prevalence"], 9)


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.table(spark, sf_dir, "lineitem")
    means = lines.agg(*[F.avg(c).alias(c) for c in SLOPES]).first()
    parts = lines.select(
        "l_orderkey",
        "l_linenumber",
        *[(F.lit(s) * (F.col(c) - F.lit(means[c]))).alias(c) for c, s in SLOPES.items()],
    )
    return parts.unpivot(["l_orderkey", "l_linenumber"], list(SLOPES), "feature", "contribution")


def global_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mean_abs_contribution(_contributions(spark, sf_dir))
    return I.rounded(df, ["mean_abs_contribution"], 9)


def strongest_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest contributions among the lines of the largest order key."""
    largest = I.table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).scalar()
    df = top_contributions(_contributions(spark, sf_dir), F.col("l_orderkey") == largest, 3)
    return I.rounded(df, ["contribution", "magnitude"], 9).select("feature", "contribution", "magnitude")


def metrics_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second model's classes at its own threshold."""
    df = I.scored(spark, sf_dir).select("y", F.col("yhat2").alias("yhat"))
    return I.rounded(class_metrics(df), MQ.RATIOS, 9)


QUERIES = {
    "key_audit": key_audit,
    "members_only": members_only,
    "non_members": non_members,
    "aligned_sets": aligned_sets,
    "salted_events": salted_events,
    "one_to_one": one_to_one,
    "candidate_ranking": candidate_ranking,
    "global_attribution": global_attribution,
    "strongest_contributions": strongest_contributions,
    "second_class_metrics": metrics_by_threshold,
}

_LINES = "m AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in SLOPES) + " FROM lineitem)"
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey, '{c}' AS feature, {s} * (lineitem.{c} - m.{c}) AS contribution FROM lineitem, m"
    for c, s in SLOPES.items()
) + ")"
_THREE = """stacked AS (
  SELECT 0 AS position, 'first' AS model, y, p, 1 AS w FROM classed
  UNION ALL SELECT 1, 'second', y, p2, 1 FROM classed
  UNION ALL SELECT 2, 'prior', y, (SELECT avg(y) FROM classed), 1 FROM classed)"""

ORACLES = {
    "key_audit": """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(0 AS BIGINT) AS missing_keys,
  CAST(sum(n - 1) AS BIGINT) AS repeated_rows FROM k""",
    "members_only": """SELECT o_orderkey, o_custkey AS c_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "non_members": I.with_ctes(
        I.COHORT_SQL, select="SELECT * FROM cohort WHERE c_custkey NOT IN (SELECT user_id FROM events)"
    ),
    "aligned_sets": I.with_ctes(
        I.SCORED_SQL, select="SELECT id, y, p AS p_a, yhat AS yhat_a, p2 AS p_b, yhat2 AS yhat_b FROM classed"
    ),
    "salted_events": """SELECT event_id, c_custkey, c_mktsegment FROM events JOIN customer ON user_id = c_custkey""",
    "one_to_one": I.with_ctes(
        I.COHORT_SQL,
        "t AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey)",
        select="SELECT c_custkey, is_churn, orders FROM cohort LEFT JOIN t ON c_custkey = o_custkey",
    ),
    "candidate_ranking": I.with_ctes(
        I.SCORED_SQL,
        _THREE,
        MQ.curve_sql("stacked", "position, model"),
        f"r AS (SELECT position, model, {MQ.AP_SQL} AS a, {MQ.AUC_SQL} AS b FROM curve GROUP BY ALL)",
        "e AS (SELECT position, avg((p - y) * (p - y)) AS brier, avg(y) AS prevalence FROM stacked GROUP BY position)",
        select="""SELECT position, model, round(a, 9) AS average_precision, round(b, 9) AS roc_auc,
  round(brier, 9) AS brier, round(prevalence, 9) AS prevalence FROM r JOIN e USING (position)""",
    ),
    "global_attribution": I.with_ctes(
        _LINES,
        _LONG,
        select="SELECT feature, round(avg(abs(contribution)), 9) AS mean_abs_contribution FROM long GROUP BY feature",
    ),
    "strongest_contributions": I.with_ctes(
        _LINES,
        _LONG,
        select="""SELECT feature, round(contribution, 9) AS contribution, round(abs(contribution), 9) AS magnitude
FROM long WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)
ORDER BY abs(contribution) DESC, feature LIMIT 3""",
    ),
    "second_class_metrics": I.with_ctes(
        I.SCORED_SQL,
        "second AS (SELECT y, yhat2 AS yhat FROM classed)",
        MQ.CELLS_SQL.format(group="", source="second", tail=""),
        select="SELECT *, " + ", ".join(f"round({q}, 9) AS {n}" for n, q in MQ.RATES_SQL.items()) + " FROM cells",
    ),
}
