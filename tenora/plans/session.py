"""The session settings that tests and the benchmark use, and one that operators with Python workers need."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 1 << 21


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tenora") -> SparkSession:
    """A local session with UTC time and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches for Python workers of about ``BATCH_BYTES``, or one row, unless the session names a size itself.

    Spark's own bounds are 10,000 rows and 64 MB. Every running task holds a batch of texts in its executor, in buffers that double as they grow and are not
    given back, and again in its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
