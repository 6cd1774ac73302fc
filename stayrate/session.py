"""Session construction and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCOPE: ContextVar[list[str] | None] = ContextVar("staged paths", default=None)


def build_session(app_name: str = "stayrate", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tested under.

    On a cluster the master, shuffle sizing and ``spark.checkpoint.dir`` come
    from ``spark-submit``; only what the caller passes is set here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``.

    A local session without the setting gets its own temporary folder; a
    cluster session without it is refused, because a machine-local folder
    would not survive the loss of its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stayrate-"))
    return context.getCheckpointDir().rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/stayrate/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where one result feeds several jobs: the lineage is cut, losing an
    executor costs nothing, and the second reader prunes columns.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_checked(df: DataFrame, label: str, check: Callable[[], object]) -> DataFrame:
    """:func:`stage`, and what was written is removed again if ``check`` raises."""
    spark = df.sparkSession
    path = work_path(spark, label)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    df.write.mode("overwrite").parquet(path)
    try:
        check()
    except BaseException:
        remove_path(spark, path)
        raise
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a table stored for joins: as many as an exchange has partitions, so the
    task that holds a partition writes whole buckets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def create_bucketed(spark: SparkSession, table: str, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """Catalogue entry for a bucketed Parquet folder, replacing one of that name."""
    quoted = f"`{key}`"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key``, with a catalogue entry.

    Tables with the same number of buckets are joined on the key without an exchange.
    """
    spark = df.sparkSession
    created = create_bucketed(spark, table, path, df.schema, key, buckets or bucket_count(spark))
    df.write.insertInto(table, overwrite=True)
    return created


def stage_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """:func:`stage`, bucketed by a key the following joins use."""
    spark = df.sparkSession
    path, table = work_path(spark, label), f"staged_{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope += [path, f"table:{table}"]
    return write_bucketed(df, table, path, key)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside is removed at the end, also after a failure.

    For flows that store their results: what they return must not be built on a
    staged table.
    """
    scope: list[str] = []
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in scope:
            if path.startswith("table:"):
                spark.sql(f"DROP TABLE IF EXISTS {path[6:]}")
            else:
                remove_path(spark, path)


def report(df: DataFrame) -> DataFrame:
    """A report of a few rows, kept as rows: it no longer reads what it was made from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Over all cores, before a step that multiplies the rows.

    Scan splits follow the stored bytes, and adaptive execution merges small
    shuffle partitions; both are too few tasks when each row is about to
    become hundreds. An explicit number of partitions is kept as it is.
    """
    spark = df.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return df.repartition(tasks, *columns)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete one path through the Hadoop file system that owns it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(file_system.delete(hadoop_path, True))


def replace_path(spark: SparkSession, path: str, target: str) -> None:
    """Put ``path`` in the place of ``target`` through the file system that owns both.

    A rename on HDFS and alike; an object store copies.
    """
    files = spark._jvm.org.apache.hadoop.fs
    file_system = files.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.delete(files.Path(target), True)
    if not file_system.rename(files.Path(path), files.Path(target)):
        raise OSError(f"cannot rename {path} to {target}")


def release_staged(spark: SparkSession) -> bool:
    """Drop everything :func:`stage` wrote for this application.

    Call it when no DataFrame built on a staged result is needed any more.
    """
    return remove_path(spark, _own_dir(spark))
