"""Intermediate tables in the folder that driver and executors share.

A staged table is an ordinary Parquet directory below ``spark.checkpoint.dir``, in a folder of its application.
Writing it cuts the lineage, and a lost executor costs only a reread. Results are lazy and read their staged tables, so these stay
until :func:`clean` is called.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-tenora-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tenora/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all staged tables of this application. Call it when every result has been written: results read them.

    The folder is deleted through the session's own file systems, so it may be wherever Spark can write.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder once and return it as a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
