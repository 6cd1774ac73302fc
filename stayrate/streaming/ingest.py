"""Activity-log ingest: CSV parts to typed Parquet, in bulk or incrementally."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from stayrate.sources.readers import read_csv
from stayrate.sources.sinks import write_parquet

# Fixed value: rows per Parquet part.
ROWS_PER_PART = 500_000


@dataclass(frozen=True)
class IngestTotals:
    """Rows and parts now in the target."""

    rows: int
    parts: int


def _totals(spark: SparkSession, target: str) -> IngestTotals:
    """Totals of the target; the row count comes from the Parquet footers."""
    stored = spark.read.parquet(target)
    return IngestTotals(stored.count(), len(stored.inputFiles()))


def ingest_batch(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType,
    rows_per_part: int = ROWS_PER_PART,
    derived: Mapping[str, Column] | None = None,
    partition_by: tuple[str, ...] = (),
) -> IngestTotals:
    """All CSV files under ``source`` to snappy Parquet parts.

    ``derived`` adds columns such as a parsed date; storing them typed (and
    partitioning by month) is what lets later window filters skip files.
    """
    logs = read_csv(spark, source, schema)
    if derived:
        logs = logs.withColumns(dict(derived))
    if partition_by:
        # Few large files per partition value; a value with most rows is split.
        logs = logs.hint("rebalance", *partition_by)
    write_parquet(logs, target, partition_by, rows_per_part)
    return _totals(spark, target)


class BatchRows(StreamingQueryListener):
    """Rows of every batch of one named query, however many there are."""

    def __init__(self, name: str):
        self.name, self.run, self.rows = name, None, {}
        self.ended = threading.Event()

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event):
        if event.progress.name == self.name:
            self.rows[event.progress.batchId] = event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId == self.run:
            self.ended.set()


def stream_source(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int = 1 << 30,
) -> DataFrame:
    """CSV folder as a stream of batches of about ``bytes_per_trigger``, or of a number of files."""
    limit = ("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", bytes_per_trigger)
    return spark.readStream.schema(schema).option("header", True).option(*limit).csv(source)


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    rows_per_part: int = ROWS_PER_PART,
    files_per_trigger: int | None = None,
    derived: Mapping[str, Column] | None = None,
    partition_by: tuple[str, ...] = (),
    bytes_per_trigger: int = 1 << 30,
) -> tuple[IngestTotals, list[int]]:
    """Take in what arrived since the last run, then stop.

    The checkpoint remembers the files already taken, and the file sink's log
    makes each batch count once even when it is retried. Returns the totals
    and the rows of each batch of this run, all of them.
    """
    stream = stream_source(spark, source, schema, files_per_trigger, bytes_per_trigger)
    if derived:
        stream = stream.withColumns(dict(derived))
    name = f"ingest_{uuid.uuid4().hex}"
    seen = BatchRows(name)
    spark.streams.addListener(seen)
    try:
        query = (
            stream.writeStream.format("parquet")
            .queryName(name)
            .partitionBy(*partition_by)
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .option("maxRecordsPerFile", rows_per_part)
            .option("compression", "snappy")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        # Events arrive in order: with the end, every batch was told.
        if not seen.ended.wait(60):
            raise TimeoutError(f"the end of stream {seen.name} was not told: its batches are not known")
    finally:
        spark.streams.removeListener(seen)
    batches = [n for _, n in sorted(seen.rows.items()) if n]
    return _totals(spark, target), batches
