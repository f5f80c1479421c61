"""Trading sessions, halts, top-of-book changes and order flow imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import mid, minute_of

LOCATE = ["trade_date", "locate"]


def session_intervals(messages: DataFrame) -> DataFrame:
    """Open intervals (lo, hi) of offsets: from an opening message to the next closing or opening one."""
    w = W.partitionBy("trade_date").orderBy("off")
    marks = messages.filter("type = 'S' and code in ('Q', 'M')").select("trade_date", "off", "code")
    return marks.withColumn("hi", F.lead("off").over(w)).filter("code = 'Q'").select("trade_date", F.col("off").alias("lo"), "hi")


def halts(messages: DataFrame) -> DataFrame:
    """trade_date, locate, off, halted of every trading-action message."""
    return messages.filter("type = 'H'").select(*LOCATE, "off", (F.col("code") != "T").alias("halted"))


def with_state(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows of (trade_date, locate, off) with open, halted and segment: how many flush triggers came before."""
    marks = messages.filter("type = 'S' and code in ('Q', 'M')").groupBy("trade_date").agg(F.sort_array(F.collect_list(F.struct("off", "code"))).alias("marks"))
    rows = rows.join(F.broadcast(marks), "trade_date", "left")  # one row a day, of its few session messages: kilobytes for decades
    before = F.filter(F.coalesce("marks", F.array().cast("array<struct<off:bigint,code:string>>")), lambda m: m["off"] < F.col("off"))
    rows = rows.withColumn("__b", before).withColumn("open", F.coalesce(F.try_element_at("__b", F.lit(-1))["code"] == "Q", F.lit(False))).withColumn("__closes", F.size(F.filter("__b", lambda m: m["code"] == "M"))).drop("__b", "marks")
    w = W.partitionBy(*LOCATE).orderBy("off", "__h").rowsBetween(W.unboundedPreceding, 0)
    both = rows.withColumn("__h", F.lit(0)).withColumn("__halt", F.lit(None).cast("boolean")).unionByName(halts(messages).select(*LOCATE, "off", F.lit(1).alias("__h"), F.col("halted").alias("__halt")), allowMissingColumns=True)
    both = both.withColumn("halted", F.coalesce(F.last("__halt", ignorenulls=True).over(w), F.lit(False))).withColumn("__stops", F.sum(F.when(F.col("__halt"), 1).otherwise(0)).over(w))
    return both.filter("__h = 0").withColumn("segment", (F.col("__closes") + F.col("__stops")).cast("long")).drop("__h", "__halt", "__stops", "__closes")


def top_changes(tops: DataFrame) -> DataFrame:
    """Rows whose top of book differs from the one before in their symbol; before the first it is empty."""
    w = W.partitionBy(*LOCATE).orderBy("off")
    names = ["bid_px", "bid_orders", "bid_qty", "ask_px", "ask_orders", "ask_qty"]
    same = F.lit(True)
    for c in names:
        same = same & (F.coalesce(F.lag(c).over(w), F.lit(0)) == F.col(c))
    return tops.withColumn("__same", same).filter("not __same").drop("__same")


def imbalance(changes: DataFrame, messages: DataFrame, minutes: int = 1) -> DataFrame:
    """Order flow imbalance: trade_date, locate, minute (the interval's first), ofi, events, mid_open, mid_close, first.

    A group ends with its interval, with a halt of its symbol, with the close and with the day, so an interval
    may have several rows, told apart by `first`, the off of the group's first row; those without events are left out.
    """
    w = W.partitionBy(*LOCATE).orderBy("off")
    rows = changes
    for c in ("bid_px", "bid_qty", "ask_px", "ask_qty"):
        rows = rows.withColumn(f"p_{c}", F.coalesce(F.lag(c).over(w), F.lit(0)))
    rows = with_state(rows, messages)
    flag = lambda cond, value: F.when(cond, value).otherwise(0)
    e = flag(F.col("bid_px") >= F.col("p_bid_px"), F.col("bid_qty")) - flag(F.col("bid_px") <= F.col("p_bid_px"), F.col("p_bid_qty")) - flag(F.col("ask_px") <= F.col("p_ask_px"), F.col("ask_qty")) + flag(F.col("ask_px") >= F.col("p_ask_px"), F.col("p_ask_qty"))
    rows = rows.filter("open and not halted and bid_qty <> 0 and ask_qty <> 0")
    minute = (F.floor(minute_of(F.col("ts_ns")) / minutes) * minutes).cast("long")
    rows = rows.withColumn("e", e).withColumn("was", (F.col("p_bid_qty") != 0) & (F.col("p_ask_qty") != 0)).withColumn("mid", mid(F.col("bid_px"), F.col("ask_px"))).withColumn("minute", minute)
    rows = rows.withColumn("mid_before", F.nullif(F.lag("mid").over(w), F.lit(0.0)))
    part = W.partitionBy(*LOCATE, "segment").orderBy("off")
    rows = rows.withColumn("new", F.when(F.lag("minute").over(part) == F.col("minute"), 0).otherwise(1)).withColumn("run", F.sum("new").over(part.rowsBetween(W.unboundedPreceding, 0)))
    found = rows.groupBy(*LOCATE, "segment", "run").agg(F.min("minute").alias("minute"), F.sum(F.when(F.col("was"), F.col("e")).otherwise(0)).cast("long").alias("ofi"), F.count_if("was").alias("events"), F.min_by(F.coalesce("mid_before", "mid"), "off").alias("mid_open"), F.max_by("mid", "off").alias("mid_close"), F.min("off").alias("first"))
    return found.filter("events > 0").drop("segment", "run")


def crossed(tops: DataFrame, messages: DataFrame) -> DataFrame:
    """Book events in market hours, not halted, with both sides and bid at or above ask."""
    return with_state(tops, messages).filter("open and not halted and bid_qty <> 0 and ask_qty <> 0 and bid_px >= ask_px").drop("open", "halted", "segment")


def directory(messages: DataFrame) -> DataFrame:
    """trade_date, locate, name: the last directory entry of each locate, without trailing spaces."""
    return messages.filter("type = 'R'").groupBy(*LOCATE).agg(F.rtrim(F.max_by("stock", "off")).alias("name"))


def named(rows: DataFrame, messages: DataFrame) -> DataFrame:
    names = directory(messages)
    return rows.join(names, LOCATE, "left").withColumn("symbol", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("locate "), F.col("locate").cast("string")))).drop("name")
