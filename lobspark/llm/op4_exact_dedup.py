"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

The log holds identifier, length and digest of every row. Every task that reads it is a memtable: its entries (a
digest, the best identifier and length, the number of rows) are combined in the task and flushed as a run, sorted by
digest. Compaction merges runs by digest ranges, level by level: first groups of about the square root of the runs,
then those; of a digest that all runs hold a task so gets that many entries at most. An index file covers one range,
is sorted by digest and has a Bloom filter on it, by which `lookup` skips files and row groups. Every row whose digest
counts more than one is a hit, and hits are verified by their bytes: of each digest the smallest and the largest
normalised text must be one text. Digests that fail this are grouped by text instead.

Texts are equal when identical after deleting `[\\x20\\x09-\\x0D]`. Of equal texts the row with the most code
points in its original text stays, then the smallest identifier. Null text counts as empty, and so equals texts
of white space only. Rows are judged one by one, by their own texts; rows that repeat an identifier count each.
As in the SQL, `kept` tells whether a row has the winner's identifier, so rows that repeat it are each marked; of
these `stage` lets one stay. A null identifier loses to any other. An empty table gives an empty result. Other
columns are ignored.
A hot digest is aggregated in the map tasks before any shuffle; the join back is one Spark can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, partitions, scratch, written

SPACE = r"[\x20\x09-\x0D]"


def _best(length: str, ident: str):
    return F.max(F.struct(F.col(length), (-F.col(ident)).alias("neg")))


class MergeIndex:
    """Runs of entries (d, n, keep, g) merged to one table, a file a digest range."""

    def __init__(self, spark: SparkSession, ranges: int) -> None:
        self.spark, self.ranges, self.entries = spark, ranges, None

    def _range(self) -> Column:
        """Digests are evenly spread, so equal shares of their first 16 bits are equal ranges."""
        return F.floor(F.conv(F.substring("d", 1, 4), 16, 10).cast("long") * self.ranges / 65536).cast("int")

    def _merged(self, runs: DataFrame, to: Column, *by: str) -> DataFrame:
        """Runs dealt to tasks by `to`, sorted there, and entries of one digest made one."""
        dealt = runs.withColumn("to", to).repartitionById(self.ranges, F.col("to")).sortWithinPartitions("to", *by, "d")
        best = dealt.groupBy("to", *by, "d").agg(F.max(F.struct("n", (-F.col("keep")).alias("neg"))).alias("b"), F.sum("g").alias("g"))
        return best.select(*by, "d", F.col("b.n").alias("n"), (-F.col("b.neg")).alias("keep"), "g")

    def build(self, log: DataFrame) -> MergeIndex:
        """From rows i, n, d."""
        held = log.withColumn("run", F.spark_partition_id()).groupBy("run", "d").agg(_best("n", "i").alias("b"), F.count("*").alias("g"))
        runs = written(held.select("run", "d", F.col("b.n").alias("n"), (-F.col("b.neg")).alias("keep"), "g").sortWithinPartitions("run", "d"), "runs")
        last = runs.agg(F.max("run")).first()[0] or 0
        fan = max(1, math.isqrt(last + 1))
        grouped = runs.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
        first = written(self._merged(grouped, F.pmod(self._range() + F.col("run"), F.lit(self.ranges)), "run"), "level1")
        path = scratch(self.spark, "index")
        whole = self._merged(first, self._range()).sortWithinPartitions("d")
        whole.write.options(**{"compression": "zstd", "parquet.bloom.filter.enabled#d": "true"}).parquet(path)
        self.entries = self.spark.read.schema(whole.schema).parquet(path)
        drop(runs)
        drop(first)
        return self

    def lookup(self, digests: list[str]) -> DataFrame:
        """Entries of some digests (lowercase hex); the reader probes the files' ranges and Bloom filters."""
        return self.entries.filter(F.col("d").isin(digests))


class _Index:
    """Digests of all rows, groups by digest, and groups of the digests that several texts share.

    rows: i, n, t, d; log: i, n, d; index: d, n, keep, g; apart: the same with the text t, None without such digests.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        spark = docs.sparkSession
        self.rows = _rows(docs, id_col, text_col)
        self.log = written(self.rows.select("i", "n", "d"), "log")
        self.index = MergeIndex(spark, partitions(spark)).build(self.log).entries
        texts = self.rows.join(self.index.filter("g > 1").select("d"), "d", "left_semi")
        # by the digest's bytes, another key than the join's, so that Spark may split a hot digest there
        told = texts.groupBy(F.unhex("d").alias("k")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        self.wrong = written(told.filter("lo <> hi").select(F.lower(F.hex("k")).alias("d")), "unequal")
        self.apart = None
        if not self.wrong.isEmpty():  # texts that differ share a digest
            self.apart = written(_merged(self.rows.join(self.wrong, "d", "left_semi"), "d", "t"), "apart")
            self.index = self.index.join(self.wrong, "d", "left_anti")


def _rows(docs: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*also, F.col(id_col).cast("long").alias("i"), F.length(text).alias("n"), F.regexp_replace(text, SPACE, "").alias("t"))
    return rows.withColumn("d", F.sha2("t", 256))


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    best = rows.groupBy(*by).agg(_best("n", "i").alias("b"), F.count("*").alias("g"))
    return best.select(*by, F.col("b.n").alias("n"), (-F.col("b.neg")).alias("keep"), "g")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row of `docs`."""
    x = _Index(docs, id_col, text_col)
    out = x.log.select("i", "d").join(x.index.select("d", "keep", "g"), "d").select("i", "keep", "g", "d")
    if x.apart is not None:
        out = out.unionByName(x.rows.select("i", "d", "t").join(x.apart.select("d", "t", "keep", "g"), ["d", "t"]).select("i", "keep", "g", "d"))
    return out.select(F.col("i").alias(id_col), F.col("keep").alias("keep_id"), F.col("g").alias("group_size"), F.col("i").eqNullSafe(F.col("keep")).alias("kept"), F.col("d").alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with their columns: exactly one row of every group."""
    x = _Index(docs, "doc_id", "text")
    whole = _rows(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), "doc_id", "text", "row")

    def winners(index: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
        """The groups' winners; c: the rows that are alike in identifier, length and `by`."""
        best = index.select(*by, F.col("n").alias("n_"), F.col("keep").alias("keep_"))
        same = rows.join(best, by).filter(F.col("i").eqNullSafe(F.col("keep_")) & (F.col("n") == F.col("n_")))
        return written(same.groupBy(*by, "n_", "keep_").agg(F.count("*").alias("c")), "winners")

    def taken(won: DataFrame, by: list[str]) -> DataFrame:
        r, w = whole.alias("r"), won.alias("w")
        on = F.col("r.i").eqNullSafe(F.col("w.keep_")) & (F.col("r.n") == F.col("w.n_"))
        for c in by:
            on = on & (F.col(f"r.{c}") == F.col(f"w.{c}"))
        return r.join(w, on, "left_semi")

    parts = [(winners(x.index, x.log, ["d"]), ["d"])]
    if x.apart is not None:
        parts.append((winners(x.apart, x.rows, ["d", "t"]), ["d", "t"]))
    out = None
    for won, by in parts:
        found = [taken(won.filter("c = 1"), by).select("row")]
        tied = won.filter("c > 1")
        if not tied.isEmpty():  # rows repeated with their identifier: any one of them
            found.append(taken(tied, by).groupBy(*by).agg(F.first("row").alias("row")).select("row"))
        for f in found:
            out = f if out is None else out.unionByName(f)
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
