"""Reading and writing the tenancy tables, snapshots and the request log."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.sources.schemas import EVENTS, REQUEST_LOG, TABLES


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables of a folder, with explicit schemas: no inference job, and columns are pruned per query."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


POINTER = "number long, snapshot string"


def _last_number(spark: SparkSession, folder: str) -> int:
    try:
        return spark.read.schema(POINTER).parquet(f"{folder}/current").agg(F.max("number")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0  # the first snapshot


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> str:
    """Write a new snapshot beside the old ones, then point to it; returns its name.

    Pointers are only added, each in a file of its own with the next number, so that at any moment readers find the old snapshot or
    the new one, whole. Of two that are written at once with one number, the greater name counts.
    """
    name = f"snapshot-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{table}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(_last_number(spark, folder) + 1, name)], POINTER).coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return name


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the snapshot that the newest pointer names."""
    name = spark.read.schema(POINTER).parquet(f"{folder}/current").agg(F.max(F.struct("number", "snapshot")).alias("last")).first()["last"]["snapshot"]
    return read_tables(spark, f"{folder}/{name}")


DAMAGED = "damaged_line"


def _log_lines(spark: SparkSession, path: str, streaming: bool, first_day: str | None, last_day: str | None) -> DataFrame:
    """Parsed lines (record) with their file; blank ones don't count."""
    rows = (spark.readStream if streaming else spark.read).text(path)
    # the log rolls daily and files carry their day as yyyyMMdd, so others are dropped before they are opened
    day = F.regexp_extract("_metadata.file_name", r"(\d{8})", 1)
    for bound, inside in ((first_day, lambda d: day >= d), (last_day, lambda d: day <= d)):
        if bound is not None:
            rows = rows.where(inside(bound.replace("-", "")))
    kind = T.StructType([*REQUEST_LOG.fields, T.StructField(DAMAGED, T.StringType())])
    record = F.from_json("value", kind, {"columnNameOfCorruptRecord": DAMAGED})
    return rows.where(F.trim("value") != "").select(record.alias("record"), F.col("_metadata.file_name").alias("file_name"))


def read_request_log(spark: SparkSession, path: str, streaming: bool = False, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """JSON lines of the request log, as a batch or a stream; ``first_day`` and ``last_day`` (yyyy-mm-dd) leave files of other days unread.

    Damaged lines are left out here; :func:`damaged_lines` has them.
    """
    return _log_lines(spark, path, streaming, first_day, last_day).where(F.col(f"record.{DAMAGED}").isNull()).select("record.*").drop(DAMAGED)


def damaged_lines(spark: SparkSession, path: str, streaming: bool = False, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Lines of the request log that are no such record, with their file: file_name, damaged_line. To be kept beside the log and counted."""
    return _log_lines(spark, path, streaming, first_day, last_day).select("file_name", f"record.{DAMAGED}").where(F.col(DAMAGED).isNotNull())


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests as a stream over Parquet files; times become instants in UTC, as watermarks need."""
    events = spark.readStream.schema(EVENTS).parquet(path)
    return events.withColumn("ts", events["ts"].cast("timestamp"))
