"""Written tables for the operators: as the library's, with settings that bound disk and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import drop, scratch, shared_root
from ..scratch import written as _written

__all__ = ["drop", "partitions", "scratch", "shared_root", "tidy", "written"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that Spark hands to Python. Counted in rows alone, 10,000 texts make a batch of any size.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def tidy(spark: SparkSession) -> None:
    """From here on, the session's queries free their shuffle files when they end (none is read by a later query),
    and Python gets batches of bounded size. Both must hold when the caller runs the lazy result, so they stay set."""
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    tidy(df.sparkSession)
    return _written(df, name, **options)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
