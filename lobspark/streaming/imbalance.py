"""The book and order flow imbalance over a stream of messages, with state for each symbol and day.

Messages arrive in order of `off` over micro-batches (files of a day one after another); within one they are sorted.
Rows at or before the last offset of their symbol are told as anomaly "out_of_order", not applied. Session messages
reach each symbol of the directory given (`locates`, a table with one row a symbol and day). State is the live
orders, the last quote and the open group; a day's state goes with its end message (S, code C).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import elapsed
from ..functions.wire import BOOK
from ..operators.book import Book

OUT = "trade_date date, locate int, minute long, ofi long, events long, mid_open double, mid_close double, anomaly string"
STATE = "orders binary, rest string"
FIELDS = ["off", "ts_ns", "type", "ref", "new_ref", "side", "shares", "price", "code"]
START = {"off": -1, "quote": [0, 0, 0, 0], "mid": 0.0, "open": False, "halted": False, "minute": None, "ofi": 0, "events": 0, "mid_open": 0.0, "top": [0] * 6}


class Symbol:
    """One symbol's day, fed message by message."""

    def __init__(self, orders: bytes = b"", rest: str = "") -> None:
        self.book = Book()
        for ref, side, price, shares in np.frombuffer(orders, np.int64).reshape(-1, 4).tolist():
            self.book.add(ref, side, shares, price)
        self.s = json.loads(rest) if rest else json.loads(json.dumps(START))

    def state(self) -> tuple[bytes, str]:
        live = [[ref, *order] for ref, order in self.book.orders.items()]
        return np.array(live, np.int64).tobytes(), json.dumps(self.s)

    def flush(self) -> Iterator[tuple]:
        s = self.s
        if s["minute"] is not None and s["events"]:
            yield s["minute"], s["ofi"], s["events"], s["mid_open"], s["mid"], None
        s["minute"], s["ofi"], s["events"] = None, 0, 0

    def feed(self, off: int, ts: int, kind: str, ref: int, new_ref: int, side: int, shares: int, price: int, code: str) -> Iterator[tuple]:
        """Finished groups (minute, ofi, events, mid_open, mid_close, None) and anomalies (five times None, anomaly)."""
        s = self.s
        if off <= s["off"]:
            yield None, None, None, None, None, "out_of_order"
            return
        s["off"] = off
        if kind == "S":
            if code in ("M", "C"):
                yield from self.flush()
            if code in ("Q", "M"):
                s["open"] = code == "Q"
        elif kind == "H":
            if code != "T":
                yield from self.flush()
            s["halted"] = code != "T"
        elif kind in BOOK:
            if odd := self.book.apply(kind, ref, new_ref, side, shares, price):
                yield None, None, None, None, None, odd
            top = [*self.book.best(0), *self.book.best(1)]
            if top != s["top"]:
                s["top"] = top
                yield from self.quote(ts, top[0], top[2], top[3], top[5])

    def quote(self, ts: int, bp: int, bq: int, ap: int, aq: int) -> Iterator[tuple]:
        s = self.s
        was_bp, was_bq, was_ap, was_aq = s["quote"]
        s["quote"] = [bp, bq, ap, aq]
        if not (s["open"] and not s["halted"] and bq and aq):
            return
        minute, mid = ts // 60_000_000_000, (bp + ap) / 20000.0
        if minute != s["minute"]:
            yield from self.flush()
            s["minute"], s["mid_open"] = minute, s["mid"] or mid
        if was_bq and was_aq:
            s["ofi"] += bq * (bp >= was_bp) - was_bq * (bp <= was_bp) - aq * (ap <= was_ap) + was_aq * (ap >= was_ap)
            s["events"] += 1
        s["mid"] = mid


def handoff(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """batch, rows, elapsed (ns from a batch's trigger to its rows being out, 0 where clocks ran back) and skewed of a query's recent batches."""
    rows = [(p["batchId"], p["numInputRows"], int(p["durationMs"].get("triggerExecution", 0))) for p in query.recentProgress]
    told = spark.createDataFrame(rows, "batch long, rows long, ms long")
    return told.select("batch", "rows", (elapsed(F.lit(0), F.col("ms")) * 1_000_000).alias("elapsed"), (F.col("ms") < 0).alias("skewed"))


def end_markers(messages: DataFrame) -> DataFrame:
    """One end message (S, code C) for each day of a table of messages, after its last one: put behind the messages, it has the stream tell its last groups."""
    last = messages.groupBy("trade_date").agg(F.max("off").alias("off"), F.max("ts_ns").alias("ts_ns"))
    cells = {"off": F.col("off") + 1, "ts_ns": F.col("ts_ns"), "type": F.lit("S"), "code": F.lit("C"), "locate": F.lit(0), "trade_date": F.col("trade_date")}
    return last.select(*[cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in messages.schema])


def imbalance_stream(messages: DataFrame, locates: DataFrame) -> DataFrame:
    """Rows of OUT from a stream of messages; rows with an anomaly have no interval. Append mode."""
    marks = messages.filter("type = 'S'").drop("locate").join(locates.select("trade_date", "locate"), "trade_date")
    rows = messages.filter(F.col("type").isin("H", *BOOK)).unionByName(marks).select("trade_date", "locate", *FIELDS)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol = Symbol(*state.get) if state.exists else Symbol()
        rows = pd.concat(list(parts)).sort_values("off")
        numbers = [rows[c].fillna(0).astype("int64").tolist() for c in ("ref", "new_ref", "side", "shares", "price")]
        out, ended = [], False
        for row in zip(rows["off"].tolist(), rows["ts_ns"].tolist(), rows["type"].tolist(), *numbers, rows["code"].tolist()):
            out += [(*key, *found) for found in symbol.feed(*row)]
            ended = ended or (row[2] == "S" and row[-1] == "C")
        if ended:
            state.remove()
        else:
            state.update(tuple(symbol.state()))
        told = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        yield told.astype({c: "Int64" for c in ("minute", "ofi", "events")})

    return rows.groupBy("trade_date", "locate").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
