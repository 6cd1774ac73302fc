"""Round trips through the sinks, the batch ingest and the incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.cleaning import parse_yyyymmdd
from stayrate.session import work_path
from stayrate.sources.readers import (
    load_predictions,
    read_parquet,
    read_text_csv,
    register,
    run_sql,
)
from stayrate.sources.sinks import write_csv, write_json, write_parquet
from stayrate.streaming.ingest import ingest_batch, ingest_stream
from stayrate.suite import inputs as I


def _log_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """All events as CSV parts with the day coded as yyyymmdd."""
    events = I.table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyyMMdd").alias("date"),
        "user_id",
        "event_type",
        "value",
        "props",
    )
    path = work_path(spark, "log-csv")
    write_csv(events.repartition(4), path)
    return path, events


def log_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV parts to typed Parquet, partitioned by month, with a stored date."""
    source, events = _log_files(spark, sf_dir)
    target = work_path(spark, "log-parquet")
    day = parse_yyyymmdd("date")
    ingest_batch(
        spark,
        source,
        target,
        events.schema,
        derived={"log_date": day, "month": F.date_format(day, "yyyy-MM")},
        partition_by=("month",),
    )
    return read_parquet(spark, target).withColumn("month", F.col("month").cast("string"))


def log_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts taken in one file at a time by a stream that then stops, by month."""
    source, events = _log_files(spark, sf_dir)
    target, checkpoint = work_path(spark, "log-stream"), work_path(spark, "log-checkpoint")
    day = parse_yyyymmdd("date")
    ingest_stream(
        spark,
        source,
        target,
        checkpoint,
        events.schema,
        files_per_trigger=1,
        derived={"log_date": day, "month": F.date_format(day, "yyyy-MM")},
        partition_by=("month",),
    )
    return read_parquet(spark, target).withColumn("month", F.col("month").cast("string"))


def prediction_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions to CSV and back under caller-named columns, gated."""
    path = work_path(spark, "predictions")
    stored = I.scored(spark, sf_dir).select(
        F.col("id").alias("customer"), F.col("y").alias("actual_class"), "p", F.col("yhat").alias("called")
    )
    write_csv(stored, path)
    text = read_text_csv(spark, path, stored.columns)
    loaded = load_predictions(text, "customer", "actual_class", "p", "called")
    return loaded.withColumn("id", F.col("id").cast("bigint"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "json")
    customers = I.table(spark, sf_dir, "customer")
    write_json(customers, path)
    return spark.read.schema(customers.schema).json(path)


def parquet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in parts of bounded size, partitioned by status, read with one glob."""
    path = work_path(spark, "parts")
    write_parquet(I.table(spark, sf_dir, "orders"), path, ["o_orderstatus"], 5_000)
    return read_parquet(spark, path).withColumn("o_orderstatus", F.col("o_orderstatus").cast("string"))


def sql_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(I.transactions(spark, sf_dir), "bound_transactions")
    return run_sql(
        spark,
        """SELECT is_cancel, count(*) AS records FROM bound_transactions
           WHERE transaction_date BETWEEN :first AND :last GROUP BY is_cancel""",
        first=I.WINDOW_START,
        last=I.WINDOW_END,
    )


QUERIES = {
    "log_ingest": log_ingest,
    "log_ingest_stream": log_ingest_stream,
    "prediction_round_trip": prediction_round_trip,
    "json_round_trip": json_round_trip,
    "parquet_parts": parquet_parts,
    "sql_binding": sql_binding,
}

_LOG = """SELECT event_id, strftime(ts, '%Y%m%d') AS date, user_id, event_type, value, props,
  CAST(ts AS DATE) AS log_date{month} FROM events"""

ORACLES = {
    "log_ingest": _LOG.format(month=", strftime(ts, '%Y-%m') AS month"),
    "log_ingest_stream": _LOG.format(month=", strftime(ts, '%Y-%m') AS month"),
    "prediction_round_trip": I.with_ctes(
        I.SCORED_SQL, select="SELECT id, y AS actual, p AS probability, yhat AS prediction FROM classed"
    ),
    "json_round_trip": "SELECT * FROM customer",
    "parquet_parts": "SELECT * FROM orders",
    "sql_binding": I.with_ctes(
        I.TRANSACTIONS_SQL,
        select="""SELECT is_cancel, count(*) AS records FROM transactions
WHERE transaction_date BETWEEN DATE '2001-01-01' AND DATE '2001-08-01' GROUP BY is_cancel""",
    ),
}
