"""The library's queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars, wire
from ..operators import book, session, stats
from ..scratch import scratch, written
from ..sources import bridge, feed
from ..streaming.imbalance import end_markers, imbalance_stream

QS = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


def _m(f, anomalies: bool = False):
    return lambda spark, d: f(bridge.messages(spark, d, anomalies))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _value(name: str, at: int, width: int, what: str, side: str) -> str:
    if what == "c":
        return f"rpad(concat(chr(CAST(65 + event_id % 26 AS int)), CAST((event_id + {at}) % 1000 AS {side})), {width}, ' ')"
    most = (1 << min(8 * width, 63)) - 1  # also the largest value; 64-bit fields are compared as signed ones
    return f"CASE WHEN event_id % 5 = 0 THEN {most} - event_id % 3 ELSE (event_id * 7919 + {at}) % {min(1 << 8 * width, 1 << 53)} END"


def _encoded(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        values = {f[0]: F.expr(_value(*f, "string")) for f in wire.FIELDS[kind]}
        return _events(spark, d).select("event_id", F.hex(wire.encode(kind, values)).alias("payload"))

    return run


def _decoded(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        values = {f[0]: F.expr(_value(*f, "string")) for f in wire.FIELDS[kind]}
        rows = _events(spark, d).select("event_id", wire.encode(kind, values).alias("payload"))
        fields = rows.select("event_id", *wire.decode(F.col("payload"), kind))
        return fields.select(*[F.col(c).cast("long").alias(c) if t.startswith("decimal") else F.col(c) for c, t in fields.dtypes])

    return run


def _encoded_sql(kind: str) -> str:
    parts, at = [f"hex('{kind}')"], 1
    for name, start, width, what in wire.FIELDS[kind]:
        if start > at:
            parts.append(f"'{'20' * (start - at)}'")
        v = _value(name, start, width, what, "varchar")
        parts.append(f"hex({v})" if what == "c" else f"lpad(hex({v}), {2 * width}, '0')")
        at = start + width
    return f"SELECT event_id, {' || '.join(parts)} AS payload FROM events"


def _decoded_sql(kind: str) -> str:
    return f"SELECT event_id, {', '.join(_value(*f, 'varchar') + ' AS ' + f[0] for f in wire.FIELDS[kind])} FROM events"


def _frames(m: DataFrame) -> DataFrame:
    short = F.when(F.col("off") % 101 == 0, 3).otherwise(0)
    return m.select("type", (wire.spec_size(F.col("type")) - short).alias("len"), "locate")


def _gaps(m: DataFrame) -> DataFrame:
    w = W.partitionBy("trade_date", "locate").orderBy("off")
    rows = m.filter("locate > 0 and type <> 'R'")
    rows = rows.withColumn("before", F.lag("ts_ns").over(w)).filter("before is not null")
    return rows.select("type", scalars.elapsed(F.floor(F.col("before") / 1000), F.floor(F.col("ts_ns") / 1000)).alias("gap"))


def _groups(m: DataFrame, minutes: int = 1) -> DataFrame:
    return session.imbalance(book.replay(m, changes=True), m, minutes)


def _ofi(m: DataFrame, minutes: int = 1) -> DataFrame:
    return _groups(m, minutes).drop("first")


def _ofi_csv(m: DataFrame) -> DataFrame:
    rows = session.named(_ofi(m), m)
    return rows.select("symbol", scalars.hh_mm(F.col("minute")).alias("minute"), "ofi", "events", "mid_open", "mid_close", "trade_date").orderBy("trade_date", "symbol", "minute")


def _crosscheck(m: DataFrame) -> DataFrame:
    """Events on which the fold and the relational plan differ: none. Both read messages that are made once."""
    m = written(m.filter(wire.is_book_event(F.col("type"))).drop("stock", "code"), "messages")
    a, b = book.replay(m).select("trade_date", "locate", "off", F.struct(*book.TOP).alias("x")), book.top_relational(m).select("trade_date", "locate", "off", F.struct(*book.TOP).alias("y"))
    return a.join(b, ["trade_date", "locate", "off"], "full").agg(F.count("*").alias("compared"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"))


def _anomalies(m: DataFrame) -> DataFrame:
    label = lambda x: F.count_if(F.col("anomaly") == x).alias(x)
    names = ("unknown_order", "duplicate_order", "zero_shares", "overfill", "bad_locate")
    return book.replay(m, num_locates=9).groupBy("trade_date").agg(*map(label, names), F.count_if(F.col("anomaly") != "").alias("total"))


def _nonbook(m: DataFrame) -> DataFrame:
    """The book's last state with and without the messages that mustn't touch it."""
    last = lambda x, name: book.depth_snapshot(x).select("qty", F.lit(name).alias("of"))
    both = last(m, "all").unionByName(last(m.filter(wire.is_book_event(F.col("type"))), "book"))
    cells = [f(F.when(F.col("of") == k, F.col("qty"))).cast("long").alias(f"{name}_{k}") for k in ("all", "book") for f, name in ((F.count, "n"), (F.sum, "qty"))]
    return both.agg(*cells)


def _own_locate(m: DataFrame) -> DataFrame:
    """Events whose top differs when some messages' headers name another locate than their orders have: none."""
    bent = m.withColumn("locate", F.when(F.col("type").isin("E", "X", "D") & (F.col("off") % 3 == 0), F.col("locate") % 8 + 1).otherwise(F.col("locate")))
    tops = lambda x: book.replay(x).select("trade_date", "locate", "off", F.struct("anomaly", *book.TOP).alias("x"))
    both = tops(m).join(tops(book.own_locates(bent)).withColumnRenamed("x", "y"), ["trade_date", "locate", "off"], "full")
    return both.agg(F.count("*").alias("events"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"))


def _replays(spark: SparkSession, d: str) -> DataFrame:
    """Days in which references are used again after their orders died, and replaced up to seven times: the last depth."""
    e = _events(spark, d)
    day, locate = F.col("ts").cast("date"), (1 + F.col("user_id") % 8).cast("int")
    base = e.select(day.alias("trade_date"), F.col("event_id").alias("id"), locate.alias("locate"), (F.col("event_id") % 8).cast("int").alias("hops"))
    step = lambda n, t, ref, new, shares, price, where: base.filter(where).select("trade_date", (F.col("id") * 16 + n).alias("off"), F.lit(t).alias("type"), "locate", ref.alias("ref"), new.cast("long").alias("new_ref"), F.when(F.lit(t) == "A", F.col("id") % 2).cast("int").alias("side"), shares.cast("long").alias("shares"), price.cast("long").alias("price"))
    ref, no, price = F.col("id") * 4, F.lit(None), F.lit(10_000) + F.col("id") % 50
    parts = [step(0, "A", ref, no, F.lit(300), price, F.lit(True)), step(1, "D", ref, no, no, no, F.lit(True)), step(2, "A", ref, no, F.lit(100), price, F.lit(True))]
    parts += [step(3 + k, "U", ref + k % 4, ref + (k + 1) % 4, F.lit(100 + 10 * k), price + k, F.col("hops") > k) for k in range(7)]
    parts.append(step(11, "E", ref + F.col("hops") % 4, no, F.lit(40), no, F.col("id") % 3 == 0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return book.depth_snapshot(out)


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """Order flow imbalance through the CSV sink, read back as text; line: the row's place in its day's file."""
    path = scratch(spark, "csv")
    m = bridge.messages(spark, d)
    feed.write_csv(session.named(_groups(m), m), path)
    rows = spark.read.option("header", True).option("inferSchema", False).schema("symbol string, minute string, ofi string, events string, mid_open string, mid_close string, trade_date date").csv(path)
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    return rows.withColumn("line", F.row_number().over(W.partitionBy("trade_date").orderBy("line")))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Order flow imbalance by the stream, over days in three files with end markers behind them."""
    m = bridge.messages(spark, d)
    whole = written(m.unionByName(end_markers(m)), "stream-messages")
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    cut = whole.groupBy("trade_date").agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    third = F.least(F.lit(2), F.floor((F.col("off") - F.col("lo")) * 3 / (F.col("hi") - F.col("lo") + 1)))
    cut = whole.join(cut, "trade_date").withColumn("third", third)
    for k in range(3):  # files come in order
        cut.filter(F.col("third") == k).select(*m.columns).coalesce(1).write.mode("append").parquet(source)
    locates = m.filter("locate > 0").select("trade_date", "locate").distinct()
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = imbalance_stream(stream, locates).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).filter("anomaly is null").drop("anomaly")


def _typed_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the messages in feed files, by name, with the reader asked for some types only."""
    root = scratch(spark, "feed")
    feed.write_feed(feed.encoded(bridge.messages(spark, d)), root)
    rows = feed.wide(feed.read_feed(spark, root, types="AFPR"))
    number = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("trade_date", "type", "locate", "tracking", "ts_ns", number("ref"), number("match"), "side", "stock", "price", "attribution", "market_category", "round_lot_size", "issue_subtype")


def _prefault(spark: SparkSession, d: str) -> DataFrame:
    """Messages persisted and touched before they are counted, as a timed replay does."""
    m = bridge.messages(spark, d).persist()
    try:
        n = m.count()
        return spark.range(1).select(F.lit(n).cast("long").alias("messages"))
    finally:
        m.unpersist()


def _through_files(spark: SparkSession, d: str) -> DataFrame:
    """Frames of feed files that the messages were written to, a file a day."""
    path = scratch(spark, "feed")
    feed.write_feed(feed.encoded(bridge.messages(spark, d)), path)
    return feed.read_feed(spark, path)


def _frame_scan(spark: SparkSession, d: str) -> DataFrame:
    return _through_files(spark, d).select("trade_date", "off", "len", "type")


def _feed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = feed.messages(_through_files(spark, d))
    return rows.filter(wire.is_book_event(F.col("type"))).select("trade_date", "type", "locate", "ts_ns", "ref", "new_ref", "side", "shares", "price")


def queries() -> dict:
    found = {
        "feed_summary": _m(lambda m: stats.feed_summary(_frames(m))),
        "type_counts": _m(stats.type_counts),
        "spec_size": _m(lambda m: m.select("type").distinct().select("type", wire.spec_size(F.col("type")).cast("int").alias("size"), wire.message_name(F.col("type")).alias("name"))),
        "malformed_count": _m(lambda m: _frames(m).groupBy("type").agg(F.count_if(F.col("len") < wire.spec_size(F.col("type"))).alias("malformed"))),
        "book_event_filter": _m(lambda m: m.filter(wire.is_book_event(F.col("type"))).groupBy("trade_date", "type").agg(F.count("*").alias("n"))),
        "nonbook_noop": _m(_nonbook),
        "symbol_directory": _m(session.directory),
        "symbol_count": _m(lambda m: session.directory(m).groupBy("trade_date").agg(F.count_if(F.col("name") != "").alias("symbols"))),
        "symbol_join": _m(lambda m: session.named(m.filter("type = 'P'").select("trade_date", "locate", "off"), m)),
        "decode_checksum": _m(stats.decode_checksum),
        "tick_grid": _m(lambda m: m.filter("price is not null").select("price").distinct().select("price", scalars.tick_of(F.col("price")).alias("tick"), scalars.price_of(scalars.tick_of(F.col("price"))).alias("back"))),
        "fmt_clock": _m(lambda m: m.select("trade_date", "off", scalars.clock(F.col("ts_ns")).alias("clock"))),
        "fmt_dollars": _m(lambda m: m.filter("price is not null").select("price").distinct().select("price", scalars.dollars(F.col("price")).alias("dollars"))),
        "fmt_commas": _m(lambda m: m.select("trade_date", "off", scalars.commas(F.col("off") * 1000).alias("text"))),
        "fmt_bytes": _m(lambda m: m.select("off").distinct().select("off", scalars.byte_text(F.col("off") * 1000000).alias("text"))),
        "fmt_quote": _m(lambda m: m.filter("price is not null and shares is not null").select("trade_date", "off", scalars.quote_text(F.col("price"), F.when(F.col("off") % 7 == 0, 0).otherwise(F.col("shares") * 1000), F.col("off") % 5).alias("text"))),
        "own_locate": _m(_own_locate),
        "depth_reused_refs": _replays,
        "ofi_csv_file": _csv,
        "ofi_stream": _stream,
        "wide_fields": _typed_from_files,
        "prefault": _prefault,
        "elapsed_clamp": _m(lambda m: m.select("trade_date", "off", scalars.elapsed(F.col("off") * 100, F.col("off") % 97 * 5000).alias("elapsed"))),
        "session_intervals": _m(session.session_intervals),
        "halt_state": _m(session.halts),
        "replace_chain": _m(book.replace_roots),
        "level_running_depth": _m(book.level_depth),
        "depth_snapshot": _m(book.depth_snapshot),
        "tob_at_event": _m(lambda m: book.replay(m).select("trade_date", "locate", "off", *book.TOP)),
        "tob_relational": _m(book.top_relational),
        "tob_final": _m(lambda m: book.replay(m).groupBy("trade_date", "locate").agg(*[F.max_by(c, "off").alias(c) for c in book.TOP])),
        "tob_changes": _m(lambda m: session.top_changes(book.replay(m)).select("trade_date", "locate", "off", *book.TOP)),
        "tob_crosscheck": _m(_crosscheck),
        "live_orders": _m(book.live_orders),
        "anomaly_counts": _m(_anomalies, True),
        "crossed_events": _m(lambda m: session.crossed(book.replay(m), m).select("trade_date", "locate", "off", *book.TOP)),
        "crossed_count": _m(lambda m: session.crossed(book.replay(m), m).groupBy("trade_date").agg(F.count("*").alias("crossed"))),
        "crossed_first_n": _m(lambda m: session.crossed(book.replay(m), m).select("trade_date", "locate", "off", "bid_px", "ask_px").orderBy("trade_date", "off").limit(10)),
        "ofi_minute": _m(_ofi),
        "ofi_30min": _m(lambda m: _ofi(m, 30)),
        "ofi_csv": _m(_ofi_csv),
        "hist_buckets": _m(lambda m: stats.histogram(_gaps(m), [], "gap")),
        "hist_stats": _m(lambda m: stats.histogram_stats(_gaps(m), ["type"], "gap").withColumn("mean", F.round("mean", 3))),
        "hist_quantiles": _m(lambda m: stats.quantiles(_gaps(m).withColumn("what", F.lit("all")), ["what"], "gap", QS)),
        "frame_scan": _frame_scan,
        "feed_roundtrip": _feed_roundtrip,
        "hist_by_type": _m(lambda m: stats.quantiles(_gaps(m), ["type"], "gap", QS, total="all").orderBy(F.desc("n"), F.col("type") != "all", "type")),
    }
    for t in wire.SIZES:
        name = f"{t}_lower" if t.islower() else t
        found[f"encode_{name}"] = _encoded(t)
        found[f"decode_{name}"] = _decoded(t)
    return found


_TOP = ", ".join(book.TOP)
_BOOK = "('A', 'F', 'E', 'C', 'X', 'D', 'U')"
_VALUES = lambda table: ", ".join(f"('{k}', {v!r})" for k, v in table.items())


def oracle_sql() -> dict[str, str]:
    m = f"WITH RECURSIVE m AS ({bridge.sql('duckdb', 'events')})"
    sizes = f"s(type, size) AS (VALUES {_VALUES(wire.SIZES)}), names(type, name) AS (VALUES {_VALUES(wire.NAMES)})"
    frames = f"{m}, {sizes}, f AS (SELECT m.type, size, size - CASE WHEN off % 101 = 0 THEN 3 ELSE 0 END AS len, locate FROM m JOIN s USING (type))"
    delta = f"""{m}, c0 AS (SELECT trade_date, ref, off, locate, side, price, shares FROM m WHERE type IN ('A', 'F')),
chain AS (SELECT trade_date, ref, off, locate, side, price, shares FROM c0 UNION ALL SELECT u.trade_date, u.new_ref, u.off, c.locate, c.side, u.price, u.shares FROM chain c JOIN m u ON u.type = 'U' AND u.trade_date = c.trade_date AND u.ref = c.ref),
x AS (SELECT *, 'c' AS k FROM chain UNION ALL SELECT m.trade_date, m.ref, m.off, chain.locate, chain.side, chain.price, m.shares, CASE WHEN m.type IN ('D', 'U') THEN 'k' ELSE 'r' END FROM m JOIN chain ON chain.trade_date = m.trade_date AND chain.ref = m.ref WHERE m.type IN ('E', 'C', 'X', 'D', 'U')),
y AS (SELECT *, sum(CASE k WHEN 'c' THEN shares WHEN 'r' THEN -shares ELSE 0 END) OVER (PARTITION BY trade_date, ref ORDER BY off) AS s FROM x),
d AS (SELECT trade_date, locate, side, price, off, CASE k WHEN 'c' THEN shares WHEN 'r' THEN -shares ELSE -s END AS dq, CASE WHEN k = 'c' THEN 1 WHEN k = 'k' OR s = 0 THEN -1 ELSE 0 END AS dn FROM y),
g AS (SELECT trade_date, locate, side, price, off, sum(dq) AS dq, sum(dn) AS dn FROM d GROUP BY ALL),
lvl AS (SELECT trade_date, locate, side, price, off, CAST(sum(dq) OVER w AS bigint) AS qty, CAST(sum(dn) OVER w AS bigint) AS orders, lead(off) OVER w AS until FROM g WINDOW w AS (PARTITION BY trade_date, locate, side, price ORDER BY off))"""
    top = f"""{delta}, bev AS (SELECT trade_date, locate, off, ts_ns FROM m WHERE type IN {_BOOK}),
live AS (SELECT bev.trade_date, bev.locate, bev.off, side, price, orders, qty FROM bev JOIN lvl ON lvl.trade_date = bev.trade_date AND lvl.locate = bev.locate AND lvl.off <= bev.off AND (until IS NULL OR bev.off < until) WHERE orders > 0),
b AS (SELECT trade_date, locate, off, max(price) AS px, arg_max(orders, price) AS orders, arg_max(qty, price) AS qty FROM live WHERE side = 0 GROUP BY ALL),
a AS (SELECT trade_date, locate, off, min(price) AS px, arg_min(orders, price) AS orders, arg_min(qty, price) AS qty FROM live WHERE side = 1 GROUP BY ALL),
t AS (SELECT bev.*, coalesce(b.px, 0) AS bid_px, coalesce(b.orders, 0) AS bid_orders, coalesce(b.qty, 0) AS bid_qty, coalesce(a.px, 0) AS ask_px, coalesce(a.orders, 0) AS ask_orders, coalesce(a.qty, 0) AS ask_qty FROM bev LEFT JOIN b USING (trade_date, locate, off) LEFT JOIN a USING (trade_date, locate, off)),
ses AS (SELECT * FROM (SELECT trade_date, off AS lo, code, lead(off) OVER (PARTITION BY trade_date ORDER BY off) AS hi FROM m WHERE type = 'S' AND code IN ('Q', 'M')) WHERE code = 'Q'),
st AS (SELECT t.*, EXISTS (SELECT 1 FROM ses WHERE ses.trade_date = t.trade_date AND lo < t.off AND (hi IS NULL OR hi > t.off)) AS is_open,
 coalesce((SELECT arg_max(h.code, h.off) FROM m h WHERE h.type = 'H' AND h.trade_date = t.trade_date AND h.locate = t.locate AND h.off < t.off), 'T') <> 'T' AS halted,
 (SELECT count(*) FROM m h WHERE h.trade_date = t.trade_date AND h.off < t.off AND ((h.type = 'H' AND h.code <> 'T' AND h.locate = t.locate) OR (h.type = 'S' AND h.code = 'M'))) AS segment FROM t),
cr AS (SELECT trade_date, locate, off, {_TOP} FROM st WHERE is_open AND NOT halted AND bid_qty <> 0 AND ask_qty <> 0 AND bid_px >= ask_px)"""
    changes = f"""{top}, ch AS (SELECT * FROM (SELECT st.*, {', '.join(f'coalesce(lag({c}) OVER w, 0) AS l_{c}' for c in book.TOP)} FROM st WINDOW w AS (PARTITION BY trade_date, locate ORDER BY off)) WHERE NOT ({' AND '.join(f'{c} = l_{c}' for c in book.TOP)}))"""

    def ofi(minutes: int) -> str:
        return f"""{changes}, q AS (SELECT *, {', '.join(f'coalesce(lag({c}) OVER w, 0) AS p_{c}' for c in ('bid_px', 'bid_qty', 'ask_px', 'ask_qty'))} FROM ch WINDOW w AS (PARTITION BY trade_date, locate ORDER BY off)),
el AS (SELECT *, (CASE WHEN bid_px >= p_bid_px THEN bid_qty ELSE 0 END) - (CASE WHEN bid_px <= p_bid_px THEN p_bid_qty ELSE 0 END) - (CASE WHEN ask_px <= p_ask_px THEN ask_qty ELSE 0 END) + (CASE WHEN ask_px >= p_ask_px THEN p_ask_qty ELSE 0 END) AS e,
 p_bid_qty <> 0 AND p_ask_qty <> 0 AS was, (bid_px + ask_px) / 20000.0::double AS mid, ts_ns // 60000000000 // {minutes} * {minutes} AS minute FROM q WHERE is_open AND NOT halted AND bid_qty <> 0 AND ask_qty <> 0),
ml AS (SELECT *, nullif(lag(mid) OVER (PARTITION BY trade_date, locate ORDER BY off), 0) AS mid_before, CASE WHEN lag(minute) OVER (PARTITION BY trade_date, locate, segment ORDER BY off) = minute THEN 0 ELSE 1 END AS fresh FROM el),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY trade_date, locate, segment ORDER BY off) AS run FROM ml),
ofi AS (SELECT trade_date, locate, min(minute) AS minute, CAST(sum(CASE WHEN was THEN e ELSE 0 END) AS bigint) AS ofi, count(*) FILTER (was) AS events, arg_min(coalesce(mid_before, mid), off) AS mid_open, arg_max(mid, off) AS mid_close, min(off) AS first FROM rn GROUP BY trade_date, locate, segment, run HAVING count(*) FILTER (was) > 0)"""

    names = "dir AS (SELECT trade_date, locate, rtrim(arg_max(stock, off)) AS name FROM m WHERE type = 'R' GROUP BY ALL)"
    gaps = f"{m}, gaps AS (SELECT * FROM (SELECT type, greatest(ts_ns // 1000 - lag(ts_ns // 1000) OVER (PARTITION BY trade_date, locate ORDER BY off), 0) AS gap, lag(ts_ns) OVER (PARTITION BY trade_date, locate ORDER BY off) AS p FROM m WHERE locate > 0 AND type <> 'R') WHERE p IS NOT NULL), bk AS (SELECT type, gap, CASE WHEN gap < 1024 THEN gap ELSE 1024 + (length(bin(gap)) - 1 - 10) * 64 + ((gap >> (length(bin(gap)) - 1 - 6)::int) & 63) END AS bucket FROM gaps)"

    def hist(by: str) -> str:
        qs = ", ".join(f"least(min(edge) FILTER (running >= greatest(1, ceil({q}::double * n_all))), max(largest)) AS {name}" for name, q in QS.items())
        every = "" if by == "'all'" else " UNION ALL SELECT 'all', bucket, count(*), max(gap) FROM bk GROUP BY ALL"
        return f"""{gaps}, cells AS (SELECT {by} AS k, bucket, count(*) AS n, max(gap) AS top FROM bk GROUP BY ALL{every}),
r AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bucket) AS running, sum(n) OVER (PARTITION BY k) AS n_all, max(top) OVER (PARTITION BY k) AS largest, CASE WHEN bucket < 1024 THEN bucket ELSE ((64 + (bucket - 1024) % 64 + 1) << ((bucket - 1024) // 64 + 4)::int) - 1 END AS edge FROM cells)
SELECT k AS {'what' if by == "'all'" else 'type'}, CAST(max(n_all) AS bigint) AS n, {qs}, max(largest) AS max FROM r GROUP BY k"""

    found = {
        "feed_summary": f"{frames} SELECT count(*) AS messages, CAST(sum(len + 2) AS bigint) AS bytes, count(*) FILTER (len < size) AS malformed, CAST(max(locate) FILTER (len >= size) AS int) AS max_locate FROM f",
        "type_counts": f"{m}, {sizes} SELECT type, count(*) AS messages, any_value(name) AS name FROM m JOIN names USING (type) GROUP BY type",
        "spec_size": f"{m}, {sizes} SELECT DISTINCT type, CAST(size AS int) AS size, name FROM m JOIN s USING (type) JOIN names USING (type)",
        "malformed_count": f"{frames} SELECT type, count(*) FILTER (len < size) AS malformed FROM f GROUP BY type",
        "book_event_filter": f"{m} SELECT trade_date, type, count(*) AS n FROM m WHERE type IN {_BOOK} GROUP BY ALL",
        "nonbook_noop": f"{delta}, z AS (SELECT sum(dq) AS q, sum(dn) AS n FROM d GROUP BY trade_date, locate, side, price) SELECT count(*) AS n_all, CAST(sum(q) AS bigint) AS qty_all, count(*) AS n_book, CAST(sum(q) AS bigint) AS qty_book FROM z WHERE n > 0",
        "symbol_directory": f"{m}, {names} SELECT * FROM dir",
        "symbol_count": f"{m}, {names} SELECT trade_date, count(*) FILTER (name <> '') AS symbols FROM dir GROUP BY trade_date",
        "symbol_join": f"{m}, {names} SELECT trade_date, locate, off, coalesce(nullif(name, ''), 'locate ' || locate) AS symbol FROM m LEFT JOIN dir USING (trade_date, locate) WHERE type = 'P'",
        "decode_checksum": f"{m} SELECT trade_date, CAST(sum(CASE WHEN type IN ('A', 'F') THEN ref + shares + price + locate WHEN type IN ('E', 'C', 'X') THEN ref + shares WHEN type = 'D' THEN ref WHEN type = 'U' THEN ref + new_ref + shares + price ELSE locate END) % 18446744073709551616 AS bigint) AS checksum FROM m GROUP BY trade_date",
        "tick_grid": f"{m}, k AS (SELECT DISTINCT price, CASE WHEN price < 10000 THEN price WHEN price % 100 <> 0 THEN NULL ELSE 10000 + (price - 10000) // 100 END AS tick FROM m WHERE price IS NOT NULL) SELECT price, tick, CASE WHEN tick < 10000 THEN tick ELSE 10000 + (tick - 10000) * 100 END AS back FROM k",
        "fmt_clock": f"{m} SELECT trade_date, off, printf('%02d:%02d:%02d.%09d', ts_ns // 3600000000000, ts_ns // 60000000000 % 60, ts_ns // 1000000000 % 60, ts_ns % 1000000000) AS clock FROM m",
        "fmt_dollars": f"{m} SELECT DISTINCT price, printf('%d.%04d', price // 10000, price % 10000) AS dollars FROM m WHERE price IS NOT NULL",
        "fmt_commas": f"{m} SELECT trade_date, off, format('{{:,}}', off * 1000) AS text FROM m",
        "fmt_bytes": f"{m} SELECT DISTINCT off, CASE WHEN off >= 1000 THEN printf('%.2f GB', off / 1000.0::double) ELSE printf('%.1f MB', off::double) END AS text FROM m",
        "fmt_quote": f"{m} SELECT trade_date, off, CASE WHEN off % 7 = 0 THEN 'none' ELSE format('{{:,}}', shares * 1000) || ' @ ' || printf('%d.%04d', price // 10000, price % 10000) || ' (' || (off % 5) || ' orders)' END AS text FROM m WHERE price IS NOT NULL AND shares IS NOT NULL",
        "own_locate": f"{m} SELECT count(*) AS events, CAST(0 AS bigint) AS mismatches FROM m WHERE type IN {_BOOK}",
        "depth_reused_refs": """WITH e AS (SELECT event_id AS id, CAST(ts AS date) AS trade_date, CAST(1 + user_id % 8 AS int) AS locate, event_id % 8 AS hops FROM events),
o AS (SELECT trade_date, locate, CAST(id % 2 AS int) AS side, CASE WHEN hops = 0 THEN 10000 + id % 50 ELSE 10000 + id % 50 + hops - 1 END AS price, CASE WHEN hops = 0 THEN 100 ELSE 100 + 10 * (hops - 1) END - CASE WHEN id % 3 = 0 THEN 40 ELSE 0 END AS shares FROM e)
SELECT trade_date, locate, side, price, CAST(sum(shares) AS bigint) AS qty, count(*) AS orders FROM o GROUP BY ALL""",
        "ofi_csv_file": f"{ofi(1)}, {names} SELECT coalesce(nullif(name, ''), 'locate ' || locate) AS symbol, printf('%02d:%02d', minute // 60, minute % 60) AS minute, CAST(ofi AS varchar) AS ofi, CAST(events AS varchar) AS events, printf('%.4f', mid_open) AS mid_open, printf('%.4f', mid_close) AS mid_close, trade_date, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY locate, minute, first) AS int) AS line FROM ofi LEFT JOIN dir USING (trade_date, locate)",
        "ofi_stream": f"{ofi(1)} SELECT trade_date, locate, minute, ofi, events, mid_open, mid_close FROM ofi",
        "wide_fields": f"""{m} SELECT trade_date, type, locate, CAST(0 AS bigint) AS tracking, ts_ns, CASE WHEN type = 'P' THEN 0 ELSE ref END AS ref, CASE WHEN type = 'P' THEN 0 END AS match, CASE WHEN type IN ('A', 'F', 'P') THEN CASE WHEN side = 1 THEN 'S' ELSE 'B' END END AS side, rpad(stock, 8, ' ') AS stock, CASE WHEN type <> 'R' THEN price END AS price, CASE WHEN type = 'F' THEN '    ' END AS attribution,
CASE WHEN type = 'R' THEN 'Q' END AS market_category, CASE WHEN type = 'R' THEN 100 END AS round_lot_size, CASE WHEN type = 'R' THEN 'Z ' END AS issue_subtype FROM m WHERE type IN ('A', 'F', 'P', 'R')""",
        "prefault": f"{m} SELECT count(*) AS messages FROM m",
        "elapsed_clamp": f"{m} SELECT trade_date, off, greatest(off % 97 * 5000 - off * 100, 0) AS elapsed FROM m",
        "session_intervals": f"{m} SELECT trade_date, lo, hi FROM (SELECT trade_date, off AS lo, code, lead(off) OVER (PARTITION BY trade_date ORDER BY off) AS hi FROM m WHERE type = 'S' AND code IN ('Q', 'M')) WHERE code = 'Q'",
        "halt_state": f"{m} SELECT trade_date, locate, off, code <> 'T' AS halted FROM m WHERE type = 'H'",
        "replace_chain": f"{m}, c AS (SELECT trade_date, ref, ref AS root, 0 AS hops FROM m WHERE type IN ('A', 'F') UNION ALL SELECT u.trade_date, u.new_ref, c.root, c.hops + 1 FROM c JOIN m u ON u.type = 'U' AND u.trade_date = c.trade_date AND u.ref = c.ref) SELECT * FROM c",
        "level_running_depth": f"{delta} SELECT trade_date, locate, side, price, off, qty, orders FROM lvl",
        "depth_snapshot": f"{delta} SELECT trade_date, locate, side, price, CAST(sum(dq) AS bigint) AS qty, CAST(sum(dn) AS bigint) AS orders FROM d GROUP BY ALL HAVING sum(dn) > 0",
        "tob_at_event": f"{top} SELECT trade_date, locate, off, {_TOP} FROM t",
        "tob_relational": f"{top} SELECT trade_date, locate, off, {_TOP} FROM t",
        "tob_final": f"{top} SELECT trade_date, locate, {', '.join(f'arg_max({c}, off) AS {c}' for c in book.TOP)} FROM t GROUP BY ALL",
        "tob_changes": f"{changes} SELECT trade_date, locate, off, {_TOP} FROM ch",
        "tob_crosscheck": f"{m} SELECT count(*) AS compared, CAST(0 AS bigint) AS mismatches FROM m WHERE type IN {_BOOK}",
        "live_orders": f"{delta}, n AS (SELECT trade_date, off, sum(sum(dn)) OVER (PARTITION BY trade_date ORDER BY off) AS live FROM d GROUP BY trade_date, off) SELECT trade_date, CAST(arg_max(live, off) AS bigint) AS live_end, CAST(max(live) AS bigint) AS live_peak FROM n GROUP BY trade_date",
        "anomaly_counts": "WITH e AS (SELECT CAST(ts AS date) AS trade_date, event_id AS id FROM events) SELECT trade_date, count(*) FILTER (id % 41 = 0) AS unknown_order, count(*) FILTER (id % 43 = 0) AS duplicate_order, count(*) FILTER (id % 47 = 0) AS zero_shares, count(*) FILTER (id % 53 = 0) AS overfill, count(*) FILTER (id % 59 = 0) AS bad_locate, count(*) FILTER (id % 59 = 0) + count(*) FILTER (id % 41 = 0) + count(*) FILTER (id % 43 = 0) + count(*) FILTER (id % 47 = 0) + count(*) FILTER (id % 53 = 0) AS total FROM e GROUP BY trade_date",
        "crossed_events": f"{top} SELECT * FROM cr",
        "crossed_count": f"{top} SELECT trade_date, count(*) AS crossed FROM cr GROUP BY trade_date",
        "crossed_first_n": f"{top} SELECT trade_date, locate, off, bid_px, ask_px FROM cr ORDER BY trade_date, off LIMIT 10",
        "ofi_minute": f"{ofi(1)} SELECT * EXCLUDE (first) FROM ofi",
        "ofi_30min": f"{ofi(30)} SELECT * EXCLUDE (first) FROM ofi",
        "ofi_csv": f"{ofi(1)}, {names} SELECT coalesce(nullif(name, ''), 'locate ' || locate) AS symbol, printf('%02d:%02d', minute // 60, minute % 60) AS minute, ofi, events, mid_open, mid_close, trade_date FROM ofi LEFT JOIN dir USING (trade_date, locate)",
        "hist_buckets": f"{gaps} SELECT CAST(bucket AS bigint) AS bucket, count(*) AS n FROM bk GROUP BY ALL",
        "hist_stats": f"{gaps} SELECT type, count(*) AS n, CAST(sum(gap) AS bigint) AS total, max(gap) AS largest, round(avg(gap), 3) AS mean FROM gaps GROUP BY type",
        "hist_quantiles": hist("'all'"),
        "hist_by_type": hist("type"),
        "frame_scan": f"{m}, {sizes} SELECT trade_date, CAST(coalesce(sum(size + 2) OVER (PARTITION BY trade_date ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS off, CAST(size AS int) AS len, type FROM m JOIN s USING (type)",
        "feed_roundtrip": f"{m} SELECT trade_date, type, locate, ts_ns, ref, new_ref, CASE WHEN type IN ('A', 'F') THEN side END AS side, shares, CASE WHEN type IN ('A', 'F', 'U', 'C') THEN price END AS price FROM m WHERE type IN {_BOOK}",
    }
    for t in wire.SIZES:
        name = f"{t}_lower" if t.islower() else t
        found[f"encode_{name}"] = _encoded_sql(t)
        found[f"decode_{name}"] = _decoded_sql(t)
    return found
