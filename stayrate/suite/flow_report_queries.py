"""Audit, comparison and training flows and the remaining gates, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.errors import DataQualityError, MissingInputError
from stayrate.operators import models as L
from stayrate.operators import quality as Q
from stayrate.operators.profile import sample_rows
from stayrate.plans import profiles, training
from stayrate.plans.comparison import compare_predictions
from stayrate.plans.panel import panel_checks
from stayrate.session import stage, work_path
from stayrate.sources import readers as R
from stayrate.sources.sinks import write_csv
from stayrate.suite import inputs as I
from stayrate.suite.metric_queries import ORACLES as METRIC_ORACLES
from stayrate.suite.model_queries import STUMP
from stayrate.suite.preparation_queries import split_sql

AUDITED = ("customer", "orders", "lineitem", "events")
IDS = {"customer": "c_custkey", "orders": "o_custkey", "lineitem": "l_suppkey", "events": "user_id"}


def _audit(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The audit flow over four given tables; customers are the population."""
    return profiles.raw_audit(
        {n: I.table(spark, sf_dir, n) for n in AUDITED},
        IDS,
        {"customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]},
        {"orders": ["o_orderdate"], "events": ["ts"]},
        {"orders": ("o_custkey", "customer", "c_custkey"), "events": ("user_id", "customer", "c_custkey")},
        "customer",
    )


def audit_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["inventory"]


def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["duplicates"].select("table_name", "rows", "duplicate_rows", "duplicate_keys")


def audit_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)["orphans"]


def compare_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction files, gated, aligned and compared: the stored table read back."""
    path = work_path(spark, "compared")
    df = I.scored(spark, sf_dir)
    sets = []
    for p, yhat in (("p", "yhat"), ("p2", "yhat2")):
        write_csv(df.select("id", "y", p, yhat), f"{path}/{p}")
        sets.append(R.load_predictions(R.read_text_csv(spark, f"{path}/{p}", ["id", "y", p, yhat]), "id", "y", p, yhat))
    compare_predictions(*sets, f"{path}/out", replicates=100)
    schema = "metric string, model_a double, model_b double, difference double"
    return I.rounded(R.read_csv(spark, f"{path}/out/comparison", schema), ["model_a", "model_b", "difference"], 9)


def _trained(spark: SparkSession, sf_dir: str, name: str, train: Callable[..., training.TrainingResult]) -> DataFrame:
    """A training flow over orders with one two-valued predictor: its stored predictions."""
    path = work_path(spark, name)
    data = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") >= 250000).cast("double").alias("dear"),
    )
    data = stage(data, "orders")
    training.split_flow(data, "id", "y", f"{path}/split", categorical=[])
    split = training.attach_split(data, R.read_parquet(spark, f"{path}/split/split_assignments"), "id")
    train(stage(split, "split-orders"), "id", "y", categorical=[], output=f"{path}/run")
    names = ["id", "actual_y", "predicted_probability", "predicted_y"]
    stored = R.load_predictions(R.read_text_csv(spark, f"{path}/run/predictions", names), *names)
    return stored.groupBy("actual", "prediction").agg(F.count("id").alias("rows"), F.min("id").alias("first_id"))


def logistic_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, "trained-linear", training.train_logistic)


def boosted_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def train(*args, **settings):
        return training.train_boosted(*args, settings={"stump": STUMP}, **settings)

    return _trained(spark, sf_dir, "trained-boosted", train)


def search_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only candidates of a name prefix may win, however good the others are."""
    df = I.table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 500000).alias("p")
    )
    better = L.Candidate("boosted", None, df)
    worse = L.Candidate("linear", None, df.withColumn("p", F.lit(0.5)))
    table = L.candidate_table([better, worse])
    eligible = table.where(F.startswith("model", F.lit("lin")))
    return I.rounded(eligible.select("model", "average_precision", "roc_auc"), ["average_precision", "roc_auc"], 9)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by month-end with measures of both signs."""
    index = F.last_day("o_orderdate").cast("timestamp_ntz")
    return (
        I.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("subscriber_id"), index.alias("index_date"))
        .agg(
            F.datediff(F.max("o_orderdate"), F.lit("1996-01-01").cast("date")).alias("account_age_days"),
            F.datediff(F.min("o_orderdate"), F.lit("1995-06-01").cast("date")).alias("subscriber_tenure_days"),
            F.count("*").alias("subscription_age_days"),
            (F.sum("o_totalprice") - 100000).alias("viewing_seconds_90d"),
            F.sum("o_totalprice").alias("amount_charged_90d"),
            F.min(F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice"))).alias("refund_amount_90d"),
        )
    )


def panel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grain gate passed, negative values counted by column."""
    return panel_checks(_panel(spark, sf_dir))


def _passes(gate: Callable[[], object]) -> bool:
    try:
        gate()
    except (DataQualityError, MissingInputError):
        return False
    return True


def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on data that meets them and on data that does not."""
    panel, orders = _panel(spark, sf_dir), I.table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    by_date = orders.withColumn("split", F.when(early, "train").otherwise("test"))
    by_status = orders.withColumn("split", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test"))
    predictors = [c for c in orders.columns if c != "o_orderkey"]
    outcomes = {
        "grain of customer and month": lambda: Q.require_unique_key(panel, ["subscriber_id", "index_date"], "panel"),
        "grain of customer": lambda: Q.require_unique_key(panel, "subscriber_id", "panel"),
        "dates in order": lambda: Q.require_chronological(by_date, "split", "o_orderdate", ["train", "test"]),
        "dates of statuses in order": lambda: Q.require_chronological(by_status, "split", "o_orderdate", ["train", "test"]),
        "no leaky column": lambda: Q.require_absent(predictors, ["o_orderkey"], "predictors"),
        "leaky status": lambda: Q.require_absent(predictors, ["o_orderstatus"], "predictors"),
        "inputs there": lambda: R.require_inputs(spark, [f"{sf_dir}/{n}.parquet" for n in AUDITED]),
        "inputs absent": lambda: R.require_inputs(spark, [f"{sf_dir}/orders.parquet", f"{sf_dir}/absent-*.parquet"]),
    }
    rows = [(name, _passes(gate)) for name, gate in outcomes.items()]
    return spark.createDataFrame(rows, "gate string, passed boolean")


def schema_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.describe(I.table(spark, sf_dir, "lineitem"))


def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with neither of two columns missing."""
    return I.training(spark, sf_dir).dropna(subset=["n_chars", "lang"]).select("doc_id", "n_chars", "lang")


def any_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any 25 orders: which ones is open, that they are 25 orders is not."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey")
    sample = stage(sample_rows(orders, 25), "sample")
    return sample.join(orders.withColumnRenamed("o_orderkey", "key"), F.col("o_orderkey") == F.col("key"), "left").agg(
        F.count("*").alias("rows"), F.count_distinct("key").alias("orders")
    )


def csv_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV tables loaded by name with no row dropped; dates that do not parse are NULL."""
    path = work_path(spark, "catalogue")
    when = F.when(F.col("event_id") % 13 == 0, "someday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    write_csv(I.table(spark, sf_dir, "events").select("event_id", when.alias("happened"), "event_type"), f"{path}/events")
    fields = [T.StructField("event_id", T.LongType()), T.StructField("happened", T.StringType()), T.StructField("event_type", T.StringType())]
    tables = R.load_tables(spark, {"logged": f"{path}/events"}, {"logged": T.StructType(fields)}, {"logged": ["happened"]})
    day = F.date_format("happened", "yyyy-MM")
    return tables["logged"].groupBy(day.alias("month")).agg(F.count("*").alias("rows"), F.max("event_id").alias("last_event"))


QUERIES = {
    "flow_audit_inventory": audit_inventory,
    "flow_audit_duplicates": audit_duplicates,
    "flow_audit_orphans": audit_orphans,
    "flow_compare": compare_flow,
    "flow_train_logistic": logistic_flow,
    "flow_train_boosted": boosted_flow,
    "search_by_prefix": search_by_prefix,
    "panel_audit": panel_audit,
    "gate_outcomes": gate_outcomes,
    "schema_description": schema_description,
    "complete_rows": complete_rows,
    "any_sample": any_sample,
    "csv_catalogue": csv_catalogue,
}

_PANEL_SQL = """panel AS (
  SELECT o_custkey, last_day(o_orderdate) AS index_date,
         date_diff('day', DATE '1996-01-01', CAST(max(o_orderdate) AS DATE)) AS a, date_diff('day', DATE '1995-06-01', CAST(min(o_orderdate) AS DATE)) AS b,
         count(*) AS c, sum(o_totalprice) - 100000 AS d, sum(o_totalprice) AS e,
         min(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice END) AS f
  FROM orders GROUP BY ALL)"""
_TRAINED_SQL = I.with_ctes(
    "data AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_totalprice >= 250000 AS INTEGER) AS dear FROM orders)",
    split_sql("data", "id", "y"),
    "placed AS (SELECT d.*, s.split FROM data d JOIN split s ON d.id = s.id)",
    # The better value scores higher: that of the larger share of ones in the training rows.
    "better AS (SELECT arg_max(dear, share) AS dear FROM (SELECT dear, avg(y) AS share FROM placed WHERE split = 'train' GROUP BY dear))",
    """rates AS (
  SELECT sum(CASE WHEN p.dear = b.dear THEN y END)::DOUBLE AS hits, count(*) FILTER (WHERE p.dear = b.dear)::DOUBLE AS called,
         sum(y)::DOUBLE AS ones, count(*)::DOUBLE AS n FROM placed p, better b WHERE split = 'validation'),
f1 AS (SELECT 2 * hits / (called + ones) AS few, 2 * ones / (n + ones) AS every, hits / called AS few_precision, ones / n AS every_precision FROM rates),
choice AS (
  SELECT CASE WHEN abs(few - every) <= 1e-8 + 1e-5 * greatest(few, every) THEN few_precision >= every_precision ELSE few > every END AS few FROM f1)""",
    select="""SELECT y AS actual, CASE WHEN NOT c.few OR p.dear = b.dear THEN 1 ELSE 0 END AS prediction, count(*) AS rows,
  min(CAST(id AS VARCHAR)) AS first_id
FROM placed p, better b, choice c WHERE split = 'test' GROUP BY ALL""",
)

ORACLES = {
    "flow_audit_inventory": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows, (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = '{n}') AS columns, "
        f"count(DISTINCT {IDS[n]}) AS distinct_ids FROM {n}"
        for n in AUDITED
    ),
    "flow_audit_duplicates": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) AS duplicate_rows, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {n})) AS duplicate_keys FROM {n}"
        for n, k in (("customer", "c_custkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey, l_linenumber"))
    ),
    "flow_audit_orphans": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS unmatched_rows, count(DISTINCT {k}) AS unmatched_keys FROM {n} "
        f"WHERE {k} IS NULL OR {k} NOT IN (SELECT c_custkey FROM customer)"
        for n, k in (("orders", "o_custkey"), ("events", "user_id"))
    ),
    "flow_compare": METRIC_ORACLES["model_comparison"],
    "flow_train_logistic": _TRAINED_SQL,
    "flow_train_boosted": _TRAINED_SQL,
    "search_by_prefix": """SELECT 'linear' AS model, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 9) AS average_precision, 0.5::DOUBLE AS roc_auc FROM orders""",
    "panel_audit": I.with_ctes(
        _PANEL_SQL,
        select=" UNION ALL ".join(
            f"SELECT 'negative_{name}' AS check_name, count(*) FILTER (WHERE {c} < 0) AS rows_found FROM panel"
            for name, c in zip(
                ("account_age_days", "subscriber_tenure_days", "subscription_age_days", "viewing_seconds_90d", "amount_charged_90d", "refund_amount_90d"), "abcdef"
            )
        ),
    ),
    "gate_outcomes": I.with_ctes(
        _PANEL_SQL,
        "dates AS (SELECT max(o_orderdate) FILTER (WHERE o_orderdate < DATE '1998-01-01') < min(o_orderdate) FILTER (WHERE o_orderdate >= DATE '1998-01-01') AS by_date, "
        "max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') < min(o_orderdate) FILTER (WHERE o_orderstatus <> 'F') AS by_status FROM orders)",
        select="""SELECT 'grain of customer and month' AS gate, count(*) = count(DISTINCT (o_custkey, index_date)) AS passed FROM panel
UNION ALL SELECT 'grain of customer', count(*) = count(DISTINCT o_custkey) FROM panel
UNION ALL SELECT 'dates in order', by_date FROM dates
UNION ALL SELECT 'dates of statuses in order', by_status FROM dates
UNION ALL SELECT 'no leaky column', TRUE UNION ALL SELECT 'leaky status', FALSE
UNION ALL SELECT 'inputs there', TRUE UNION ALL SELECT 'inputs absent', FALSE""",
    ),
    "schema_description": """SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
  CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz'
       ELSE lower(data_type) END AS column_type
FROM information_schema.columns WHERE table_name = 'lineitem'""",
    "complete_rows": I.with_ctes(
        I.TRAINING_SQL, select="SELECT doc_id, n_chars, lang FROM training WHERE n_chars IS NOT NULL AND lang IS NOT NULL"
    ),
    "any_sample": "SELECT least(25, count(*)) AS rows, least(25, count(*)) AS orders FROM orders",
    "csv_catalogue": """SELECT CASE WHEN event_id % 13 <> 0 THEN strftime(ts, '%Y-%m') END AS month, count(*) AS rows, max(event_id) AS last_event
FROM events GROUP BY ALL""",
}
