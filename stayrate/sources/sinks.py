"""Sinks: Parquet, CSV, JSON reports and fitted pipelines."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession

from stayrate.operators.quality import Watch
from stayrate.session import bucket_count, create_bucketed, remove_path, replace_path, write_bucketed

# A stored table that a statement reads.
_DICTIONARY = re.compile(r"parquet\.`([^`]+)`")


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    max_rows_per_file: int | None = None,
) -> None:
    """Snappy Parquet, replacing what was there."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if max_rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def publish(
    df: DataFrame,
    watch: Watch,
    path: str,
    rows: int | None = None,
    table: str | None = None,
    key: str | None = None,
) -> int:
    """Write ``df``, built on ``watch.over``, and let it appear at ``path`` if the watch passes.

    The rows go to a folder beside ``path`` and are counted by the tasks that write them; a
    violated rule removes the folder and leaves what was at ``path`` before. With ``table``
    and ``key`` the folder is bucketed and sorted by the key and gets a catalogue entry, so
    tables published alike are joined without an exchange. Returns the number of rows.
    """
    spark = df.sparkSession
    pending, entry = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex}", f"pending_{uuid.uuid4().hex}"
    try:
        if table is None:
            write_parquet(df, pending)
        else:
            write_bucketed(df, entry, pending, key)
            spark.sql(f"DROP TABLE {entry}")
        found = watch.check(rows)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {entry}")
        remove_path(spark, pending)
        raise
    replace_path(spark, pending, path)
    if table is not None:
        create_bucketed(spark, table, path, df.schema, key, bucket_count(spark))
    return found


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with headers; part files are written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def write_json_document(spark: SparkSession, document: Mapping, path: str) -> None:
    """A single small document (settings, metrics) as one JSON line."""
    text = json.dumps(document, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_model(
    model: PipelineModel, path: str, threshold: float, columns: Sequence[str], **extra
) -> None:
    """Fitted pipeline with its threshold and feature list beside it.

    Dictionaries that a stage joins are copied into the folder, so that the saved model
    needs nothing else.
    """
    spark = SparkSession.active()
    stages = []
    for i, stage in enumerate(model.stages):
        if isinstance(stage, SQLTransformer):
            used = dict.fromkeys(_DICTIONARY.findall(stage.getStatement()))
            statement = stage.getStatement()
            for j, old in enumerate(used):
                own = f"{path}/dictionary-{i}-{j}"
                write_parquet(spark.read.parquet(old), own)
                statement = statement.replace(f"parquet.`{old}`", f"parquet.`{own}`")
            stage = SQLTransformer(statement=statement)
        stages.append(stage)
    PipelineModel(stages).write().overwrite().save(f"{path}/pipeline")
    document = {"threshold": threshold, "columns": list(columns), **extra}
    write_json_document(spark, document, f"{path}/settings")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.active()
    return PipelineModel.load(f"{path}/pipeline"), read_json_document(spark, f"{path}/settings")
