"""Scans: CSV as text or typed, Parquet files and globs, named catalogues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.errors import MissingInputError
from stayrate.functions.cleaning import parse_timestamp, strict_cast
from stayrate.operators.quality import require, require_columns
from stayrate.sources.schemas import TIMESTAMP_FORMATS, text_schema


def require_inputs(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise one error naming every path (or glob) that matches nothing."""
    configuration = spark._jsc.hadoopConfiguration()
    missing = []
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        matches = hadoop_path.getFileSystem(configuration).globStatus(hadoop_path)
        if matches is None or len(matches) == 0:
            missing.append(path)
    if missing:
        raise MissingInputError(missing)


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header, every column as text."""
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .schema(text_schema(list(columns)))
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header and a declared schema.

    Without a schema the types are inferred, which reads the file twice; keep
    that for profiling files of unknown layout.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet file, folder or glob."""
    return spark.read.parquet(path)


def load_tables(
    spark: SparkSession,
    paths: Mapping[str, str],
    schemas: Mapping[str, T.StructType],
    date_columns: Mapping[str, Sequence[str]] | None = None,
    register: bool = False,
) -> dict[str, DataFrame]:
    """Named CSV tables with no row dropped; listed date columns parsed tolerantly."""
    require_inputs(spark, list(paths.values()))
    tables = {}
    for name, path in paths.items():
        table = read_csv(spark, path, schemas[name])
        dates = (date_columns or {}).get(name, [])
        if dates:
            table = table.withColumns({c: parse_timestamp(c, TIMESTAMP_FORMATS) for c in dates})
        tables[name] = table
        if register:
            table.createOrReplaceTempView(name)
    return tables


def load_cohort(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Cohort from an all-text source: strict casts to (string id, int label)."""
    return df.select(
        strict_cast(id_col, "string").alias(id_col),
        strict_cast(label_col, "int").alias(label_col),
    )


def load_predictions(
    df: DataFrame,
    id_col: str,
    actual_col: str,
    probability_col: str,
    prediction_col: str,
    subject: str = "predictions",
) -> DataFrame:
    """Scored set ``(id, actual, probability, prediction)`` from caller-named columns.

    Gates: columns present, not empty, nothing missing, labels and classes in
    {0, 1}, probability in [0, 1].
    """
    require_columns(df, [id_col, actual_col, probability_col, prediction_col], subject)
    scored = df.select(
        F.col(id_col).alias("id"),
        strict_cast(actual_col, "int").alias("actual"),
        strict_cast(probability_col, "double").alias("probability"),
        strict_cast(prediction_col, "int").alias("prediction"),
    )
    any_null = (
        F.col("id").isNull()
        | F.col("actual").isNull()
        | F.col("probability").isNull()
        | F.col("prediction").isNull()
    )
    require(
        scored,
        {
            "missing_values": any_null,
            "bad_actual": ~F.col("actual").isin(0, 1),
            "bad_prediction": ~F.col("prediction").isin(0, 1),
            "bad_probability": ~F.col("probability").between(0.0, 1.0)
            | F.isnan("probability"),
        },
        subject,
        allow_empty=False,
    )
    return scored


def register(df: DataFrame, name: str, materialise: bool = False) -> DataFrame:
    """Temp view; ``materialise`` keeps the rows for the several jobs to come."""
    table = df.persist() if materialise else df
    table.createOrReplaceTempView(name)
    return table


def describe(df: DataFrame) -> DataFrame:
    """Column names and types as a table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def run_sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """SQL text with bound named parameters (``:name``)."""
    return spark.sql(text, args=parameters)
