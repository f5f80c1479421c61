"""The limit order book: a relational form by windows, and an exact fold that knows every anomaly."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.wire import BOOK
from ..scratch import drop, written

KEY = ["trade_date", "locate"]
FAN = 62  # levels or winners that meet in one round of `side_tops`: bits of a long
TOP = ["bid_px", "bid_orders", "bid_qty", "ask_px", "ask_orders", "ask_qty"]


def lives(messages: DataFrame) -> DataFrame:
    """One row for each thing that happens to an order: trade_date, ref, off, k, type, shares, locate, side, price, made.

    k: c (made), r (reduced), k (killed). made: off of the message that made the order, which names one life of a
    reference, as references may be used again; null where none did. A replace kills one order and makes another.
    """
    t = F.col("type")
    adds = messages.filter(t.isin("A", "F")).select("trade_date", "ref", "off", F.lit("c").alias("k"), "type", "shares", "locate", "side", "price")
    replaced = messages.filter("type = 'U'").select("trade_date", F.col("new_ref").alias("ref"), "off", F.lit("c").alias("k"), "type", "shares", "locate", F.lit(None).cast("int").alias("side"), "price")
    acts = messages.filter(t.isin("E", "C", "X", "D", "U")).select("trade_date", "ref", "off", F.when(t.isin("D", "U"), "k").otherwise("r").alias("k"), "type", "shares", "locate", F.lit(None).cast("int").alias("side"), F.lit(None).cast("long").alias("price"))
    life = W.partitionBy("trade_date", "ref").orderBy("off", F.col("k") == "c").rowsBetween(W.unboundedPreceding, 0)
    return adds.unionByName(replaced).unionByName(acts).withColumn("made", F.last(F.when(F.col("k") == "c", F.col("off")), ignorenulls=True).over(life))


def chain_roots(rows: DataFrame, rounds: int = 64) -> DataFrame:
    """trade_date, made, root, hops of every order that a replace made (rows of `lives`): root is the off of the chain's first order.

    Pointer doubling: a chain of n replaces takes log2(n) rounds, each written to the shared folder when this is called.
    """
    links = written(rows.filter("type = 'U' and k = 'k' and made is not null").select("trade_date", F.col("off").alias("made"), F.col("made").alias("root"), F.lit(1).alias("hops"), F.lit(True).alias("moved")), "links")
    for _ in range(rounds):
        up = links.select("trade_date", F.col("made").alias("root"), F.col("root").alias("above"), F.col("hops").alias("more"))
        joined = links.join(up, ["trade_date", "root"], "left")
        after = written(joined.select("trade_date", "made", F.coalesce("above", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("above").isNotNull().alias("moved")), "links")
        drop(links)
        links = after
        if links.filter("moved").isEmpty():
            return links.drop("moved")
    raise RuntimeError("replace chains did not settle")


def replace_roots(messages: DataFrame) -> DataFrame:
    """trade_date, ref, root, hops: the first order of every order's replace chain; a row for each order, also of one reference."""
    rows = written(lives(messages), "lives")
    orders = rows.filter("k = 'c'").select("trade_date", "ref", "made")
    roots = orders.join(chain_roots(rows), ["trade_date", "made"], "left").withColumn("root", F.coalesce("root", "made"))
    first = orders.select("trade_date", F.col("ref").alias("first"), F.col("made").alias("root"))
    return roots.join(first, ["trade_date", "root"]).select("trade_date", "ref", F.col("first").alias("root"), F.coalesce("hops", F.lit(0)).alias("hops"))


def origins(rows: DataFrame) -> DataFrame:
    """trade_date, made, locate, side of every order: those of its chain's first one."""
    adds = rows.filter("k = 'c' and type <> 'U'").select("trade_date", F.col("made").alias("root"), "locate", "side")
    made = rows.filter("k = 'c'").select("trade_date", "made").join(chain_roots(rows), ["trade_date", "made"], "left")
    return made.withColumn("root", F.coalesce("root", "made")).join(adds, ["trade_date", "root"]).select("trade_date", "made", "locate", "side")


def own_locates(messages: DataFrame) -> DataFrame:
    """Messages whose executions, cancels, deletes and replaces carry their order's locate, whatever their header names."""
    rows = written(lives(messages), "lives")
    own = rows.filter("k <> 'c'").select("trade_date", "off", "made").join(origins(rows).select("trade_date", "made", F.col("locate").alias("own")), ["trade_date", "made"])
    return messages.join(own.select("trade_date", "off", "own"), ["trade_date", "off"], "left").withColumn("locate", F.coalesce("own", "locate")).select(*messages.columns)


def deltas(messages: DataFrame) -> DataFrame:
    """trade_date, locate, side, price, off, dq, dn: what each message adds to or takes from a price level.

    For feeds without anomalies. A message acts on its order's own locate, side and price. What is left of an order is
    told from its reference's running sum, in the window that tells its life; only orders that a replace made are joined
    with their chain's first one.
    """
    k = F.col("k")
    life = W.partitionBy("trade_date", "ref").orderBy("off", k == "c").rowsBetween(W.unboundedPreceding, 0)
    change = F.when(k == "c", F.col("shares")).when(k == "r", -F.col("shares"))
    rows = lives(messages).withColumn("sum", F.sum(F.coalesce(change, F.lit(0))).over(life))
    born = F.struct("locate", "side", "price", F.col("type").alias("by"), (F.col("sum") - F.coalesce("shares", F.lit(0))).alias("before"))
    rows = rows.withColumn("born", F.last(F.when((k == "c") & F.col("off").isNotNull(), born), ignorenulls=True).over(life)).filter("made is not null")
    s = F.col("sum") - F.col("born.before")
    dq = F.when(k == "c", F.col("shares")).when(k == "r", -F.col("shares")).otherwise(-s)
    dn = F.when(k == "c", 1).when((k == "k") | (s == 0), -1).otherwise(0)
    rows = written(rows.select("trade_date", "off", "k", "type", "made", "born.by", "born.locate", "born.side", "born.price", dq.alias("dq"), dn.cast("long").alias("dn")), "lives")
    cells = ["trade_date", "locate", "side", "price", "off", "dq", "dn"]
    first = rows.filter("k = 'c' and by <> 'U'").select("trade_date", F.col("made").alias("root"), "locate", "side")
    of = chain_roots(rows).join(first, ["trade_date", "root"]).select("trade_date", "made", "locate", "side")
    replaced = rows.filter("by = 'U'").drop("locate", "side").join(of, ["trade_date", "made"]).select(cells)
    return rows.filter("by <> 'U' and trade_date is not null").select(cells).unionByName(replaced)


def level_depth(messages: DataFrame) -> DataFrame:
    """Running quantity and orders of every price level after every message that touches it."""
    w = W.partitionBy("trade_date", "locate", "side", "price").orderBy("off")
    upto = w.rangeBetween(W.unboundedPreceding, 0)  # with all that its message changes
    rows = deltas(messages).select("trade_date", "locate", "side", "price", "off", F.sum("dq").over(upto).alias("qty"), F.sum("dn").over(upto).alias("orders"), F.lead(F.struct("off")).over(w).alias("next"))
    return rows.filter("next is null or not next.off <=> off").drop("next")


def depth_snapshot(messages: DataFrame) -> DataFrame:
    """Levels with orders at the end of each day."""
    return deltas(messages).groupBy("trade_date", "locate", "side", "price").agg(F.sum("dq").cast("long").alias("qty"), F.sum("dn").cast("long").alias("orders")).filter("orders > 0")


def side_tops(levels: DataFrame) -> DataFrame:
    """trade_date, locate, side, off, orders, price, qty: the best level of a side after every message that touches it or makes another one best; orders is 0 while it is empty.

    A tournament over ranks of prices: in each round FAN neighbours meet, of which the best with orders wins. A running
    sum has a bit for each neighbour with orders, so its lowest bit is the winner; where that is not the neighbour just
    touched, the winner's last row is asked for. Only rows of winners go on, at most one a message, and log(prices)
    rounds are needed.
    """
    levels = levels.filter("side in (0, 1) and price is not null and locate is not null").withColumn("live", (F.col("orders") > 0).cast("long"))
    flip = F.col("live") - F.coalesce(F.lag("live").over(W.partitionBy(*KEY, "side", "price").orderBy("off")), F.lit(0))
    levels = written(levels.withColumn("flip", flip).drop("live"), "levels")
    ranks = levels.select(*KEY, "side", "price").distinct()
    by = W.partitionBy(*KEY, "side").orderBy(F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price")))
    ranks = written(ranks.withColumn("node", (F.row_number().over(by) - 1).cast("long")), "ranks")
    most = ranks.agg(F.max("node")).first()[0] or 0
    values = F.struct(F.col("off").alias("at"), "orders", "price", "qty")
    rows = levels.join(ranks, [*KEY, "side", "price"]).select(*KEY, "side", "node", "off", "flip", values.alias("v"))
    group = W.partitionBy(*KEY, "side", "up").orderBy("off")
    own = W.partitionBy(*KEY, "side", "up", "slot").orderBy("off", "asked").rowsBetween(W.unboundedPreceding, 0)
    while True:
        rows = rows.select(*KEY, "side", F.floor(F.col("node") / FAN).alias("up"), (F.col("node") % FAN).cast("int").alias("slot"), "off", "flip", "v")
        rows = rows.withColumn("mask", F.sum(F.expr("shiftleft(flip, slot)")).over(group.rangeBetween(W.unboundedPreceding, 0)))
        rows = rows.withColumn("best", F.expr("CASE WHEN mask = 0 THEN -1 ELSE bit_count((mask & -mask) - 1) END"))
        rows = rows.withColumn("was", F.coalesce(F.lag("best").over(group), F.lit(-1))).withColumn("before", F.lag("off").over(group))
        touched = F.expr("struct(slot, 0 AS asked, best = slot AS wins, v)")
        asked = F.expr("struct(best AS slot, 1 AS asked, true AS wins, CAST(NULL AS struct<at: bigint, orders: bigint, price: bigint, qty: bigint>) AS v)")
        other = F.expr("best <> slot AND best <> was AND (before IS NULL OR before <> off)")
        rows = rows.select(*KEY, "side", "up", "off", F.inline(F.when(other, F.array(touched, asked)).otherwise(F.array(touched))))
        rows = rows.withColumn("v", F.last("v", ignorenulls=True).over(own)).filter("wins and (asked = 0 or not v.at <=> off)")
        cells = [F.coalesce(f"v.{c}", F.lit(0).cast("long")).alias(c) for c in ("orders", "price", "qty")]
        rows = rows.select(*KEY, "side", F.col("up").alias("node"), "off", *cells)
        if most < FAN:
            return rows.drop("node")
        most //= FAN
        live = (F.col("orders") > 0).cast("long")
        flip = live - F.coalesce(F.lag(live).over(W.partitionBy(*KEY, "side", "node").orderBy("off")), F.lit(0))
        rows = rows.select(*KEY, "side", "node", "off", flip.alias("flip"), values.alias("v"))


def top_relational(messages: DataFrame) -> DataFrame:
    """Top of book after every book event, by windows over the levels' changes alone: a cross-check of `replay`."""
    tops = side_tops(level_depth(messages)).withColumn("at", F.lit(0))
    at = messages.filter(F.col("type").isin(*BOOK)).select(*KEY, "off", F.lit(1).alias("at"))
    both = tops.unionByName(at, allowMissingColumns=True)
    w = W.partitionBy(*KEY).orderBy("off", "at").rowsBetween(W.unboundedPreceding, 0)
    of = lambda side, c: F.last(F.when(F.col("side") == side, F.col(c)), ignorenulls=True).over(w)
    cells = [F.coalesce(of(side, c), F.lit(0)).cast("long").alias(f"{n}_{g}") for side, n in ((0, "bid"), (1, "ask")) for c, g in (("price", "px"), ("orders", "orders"), ("qty", "qty"))]
    return both.select(*KEY, "off", "at", *cells).filter("at = 1").drop("at")


class Book:
    """One symbol's book. Rules in the order in which they apply; anomalies are told, not raised."""

    def __init__(self) -> None:
        self.orders: dict[int, list[int]] = {}  # ref -> side, price, shares
        self.levels: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})  # price -> qty, orders
        self.heaps: tuple[list[int], list[int]] = ([], [])  # signed prices; dead ones are dropped when seen
        self.tops: list[tuple[int, int, int] | None] = [None, None]  # what `best` found, while it holds

    def add(self, ref: int, side: int, shares: int, price: int) -> str:
        if shares == 0:
            return "zero_shares"
        if ref in self.orders:
            return "duplicate_order"
        self.orders[ref] = [side, price, shares]
        top = self.tops[side]
        if top is not None and (not top[1] or (price <= top[0] if side else price >= top[0])):
            self.tops[side] = None
        level = self.levels[side].get(price)
        if level is None:
            self.levels[side][price] = [shares, 1]
            heapq.heappush(self.heaps[side], price if side else -price)
        else:
            level[0] += shares
            level[1] += 1
        return ""

    def reduce(self, ref: int, shares: int | None) -> str:
        """Take shares from an order; None takes all."""
        order = self.orders.get(ref)
        if order is None:
            return "unknown_order"
        side, price, left = order
        over = shares is not None and shares > left
        take = left if shares is None or over else shares
        top = self.tops[side]
        if top is not None and price == top[0]:
            self.tops[side] = None
        level = self.levels[side][price]
        level[0] -= take
        order[2] -= take
        if order[2] == 0:
            del self.orders[ref]
            level[1] -= 1
            if level[1] == 0:
                del self.levels[side][price]
        return "overfill" if over else ""

    def replace(self, ref: int, new_ref: int, shares: int, price: int) -> str:
        order = self.orders.get(ref)
        if order is None:
            return "unknown_order"
        side = order[0]
        self.reduce(ref, None)
        return self.add(new_ref, side, shares, price)

    def apply(self, kind: str, ref: int, new_ref: int, side: int, shares: int, price: int) -> str:
        if kind in "AF":
            return self.add(ref, side, shares, price)
        if kind in "ECX":
            return self.reduce(ref, shares)
        return self.reduce(ref, None) if kind == "D" else self.replace(ref, new_ref, shares, price)

    def best(self, side: int) -> tuple[int, int, int]:
        top = self.tops[side]
        if top is None:
            heap, levels, top = self.heaps[side], self.levels[side], (0, 0, 0)
            while heap:
                price = heap[0] if side else -heap[0]
                if price in levels:
                    qty, orders = levels[price]
                    top = price, orders, qty
                    break
                heapq.heappop(heap)
            self.tops[side] = top
        return top


NONE = 1 << 40  # a day or locate that is null


def plain(column: pa.Array, null: int) -> list[int]:
    """Whole numbers as a list, by numpy: `to_pylist` takes longer than the fold itself."""
    return column.fill_null(null).to_numpy(zero_copy_only=False).tolist()


FOLD = pa.schema([("trade_date", pa.date32()), ("locate", pa.int32()), ("off", pa.int64()), ("ts_ns", pa.int64()), ("anomaly", pa.string()), ("live", pa.int64()), *((c, pa.int64()) for c in TOP)])


def replay(messages: DataFrame, num_locates: int | None = None, changes: bool = False) -> DataFrame:
    """The exact fold: one row for each book event, with its anomaly, live orders of the locate and top of book.

    A task walks its symbols' days one after another, message by message; what it holds is one book and a batch.
    Adds with a locate of `num_locates` and more, if given, are anomalies. Messages of an order are taken to carry
    its locate, as on a clean feed; `own_locates` makes them so. changes: only rows whose top of book differs from the
    one before in their symbol's day (empty at first), as `session.top_changes` gives, but without a shuffle of the rest.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, at, book, last = None, None, Book(), ((0, 0, 0), (0, 0, 0))
        for batch in batches:
            keep, odds, live, bids, asks = [], [], [], [], []
            days, locates = (plain(batch.column(k).cast(pa.int32()).cast(pa.int64()), NONE) for k in (0, 1))
            kinds = batch.column(4).dictionary_encode()
            names = kinds.dictionary.to_pylist()
            numbers = [plain(batch.column(k), 0) for k in range(5, 10)]
            for row, (day, locate, kind, ref, new_ref, side, shares, price) in enumerate(zip(days, locates, plain(kinds.indices, 0), *numbers)):
                kind = names[kind]
                if locate != at or day != on:
                    on, at, book, last = day, locate, Book(), ((0, 0, 0), (0, 0, 0))
                if num_locates is not None and locate >= num_locates and kind in "AF" and shares:
                    odd = "bad_locate"
                else:
                    odd = book.apply(kind, ref, new_ref, side, shares, price)
                bid, ask = book.best(0), book.best(1)
                if changes:
                    if (bid, ask) == last:
                        continue
                    last = bid, ask
                    keep.append(row)
                odds.append(odd)
                live.append(len(book.orders))
                bids.append(bid)
                asks.append(ask)
            same = batch.select([0, 1, 2, 3])
            same = same.take(pa.array(keep, pa.int64())) if changes else same
            tops = [list(c) for side in (bids, asks) for c in zip(*side)] or [[]] * 6
            cells = [*(c.cast(t) for c, t in zip(same.columns, FOLD.types)), *map(pa.array, (odds, live, *tops), FOLD.types[4:])]
            yield pa.RecordBatch.from_arrays(cells, schema=FOLD)

    needed = messages.filter(F.col("type").isin(*BOOK)).select("trade_date", "locate", "off", "ts_ns", "type", "ref", "new_ref", "side", "shares", "price")
    schema = "trade_date date, locate int, off long, ts_ns long, anomaly string, live long, " + ", ".join(f"{c} long" for c in TOP)
    return needed.repartition(*KEY).sortWithinPartitions(*KEY, "off").mapInArrow(fold, schema)


def live_orders(messages: DataFrame, parts: int = 1024) -> DataFrame:
    """Per day: live orders at the end, and the most at any time. A day's offsets are summed in `parts` ranges, whose sums (a row each) are summed in order."""
    by = written(deltas(messages).groupBy("trade_date", "off").agg(F.sum("dn").alias("dn")), "changes")
    span = by.groupBy("trade_date").agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    cut = by.join(span, "trade_date").withColumn("part", F.floor((F.col("off") - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1)))
    inside = W.partitionBy("trade_date", "part").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    ends = cut.withColumn("live", F.sum("dn").over(inside)).groupBy("trade_date", "part").agg(F.max("live").alias("peak"), F.sum("dn").alias("n"))
    before = W.partitionBy("trade_date").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumn("end", F.sum("n").over(before)).withColumn("peak", F.col("peak") + F.col("end") - F.col("n"))
    return ends.groupBy("trade_date").agg(F.max_by("end", "part").cast("long").alias("live_end"), F.max("peak").cast("long").alias("live_peak"))
