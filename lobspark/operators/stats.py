"""Summaries, checksums and log-linear histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bucket, bucket_edge
from ..functions.wire import message_name, spec_size


def type_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type").agg(F.count("*").alias("messages")).withColumn("name", message_name(F.col("type"))).orderBy(F.desc("messages"), "type")


def feed_summary(frames: DataFrame) -> DataFrame:
    """messages, bytes, malformed and the largest locate of known, whole messages; frames: type, len, locate."""
    size = spec_size(F.col("type"))
    bad = (size > 0) & (F.col("len") < size)
    return frames.agg(F.count("*").alias("messages"), F.sum(F.col("len") + 2).cast("long").alias("bytes"), F.count_if(bad).alias("malformed"), F.max(F.when((size > 0) & ~bad, F.col("locate"))).cast("int").alias("max_locate"))


def decode_checksum(messages: DataFrame) -> DataFrame:
    """Per day: the sum of decoded fields, modulo 2**64."""
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    t = F.col("type")
    value = F.when(t.isin("A", "F"), d("ref") + d("shares") + d("price") + d("locate")).when(t.isin("E", "C", "X"), d("ref") + d("shares")).when(t == "D", d("ref")).when(t == "U", d("ref") + d("new_ref") + d("shares") + d("price")).otherwise(d("locate"))
    return messages.groupBy("trade_date").agg((F.sum(value.cast("decimal(28,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("long").alias("checksum"))


def histogram(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, bucket, n: partial histograms merge in the aggregate."""
    return values.groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_stats(values: DataFrame, by: list[str], value: str) -> DataFrame:
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).cast("long").alias("total"), F.max(value).alias("largest"), F.avg(value).alias("mean"))


def quantiles(values: DataFrame, by: list[str], value: str, qs: dict[str, float], total: str | None = None) -> DataFrame:
    """Exact-rank bucket quantiles and the maximum: the upper edge of the first bucket whose running count reaches ceil(q n), at most the maximum.

    total: also a row for all values together, with this name in each column of `by`; its cells are sums of the others'.
    """
    cells = values.groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"), F.max(value).alias("top"))
    if total is not None:
        every = cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        cells = cells.unionByName(every.select(*[F.lit(total).alias(c) for c in by], "bucket", "n", "top"))
    w = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    all_rows = W.partitionBy(*by)
    cells = cells.withColumn("running", F.sum("n").over(w)).withColumn("all", F.sum("n").over(all_rows)).withColumn("largest", F.max("top").over(all_rows)).withColumn("edge", bucket_edge(F.col("bucket")))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("all")))
    return cells.groupBy(*by).agg(F.max("all").alias("n"), *[F.least(F.min(F.when(F.col("running") >= rank(q), F.col("edge"))), F.max("largest")).alias(name) for name, q in qs.items()], F.max("largest").alias("max"))
