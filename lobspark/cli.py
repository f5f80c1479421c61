"""Command lines: `python -m lobspark.cli verify|bench|pipeline|gen`.

Each ends with status 0 when all is well, 1 on a failure (told on the standard error as `error: ...`) and 2 without a
file. Reports are lines of a name and a text; `report` functions give them as (metric, value) pairs.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import wire
from .operators import book, session, stats
from .sources import feed, synthetic

#: Of each command: its positional argument, and its options with what they take.
OPTIONS = {
    "verify": ("FILE", {"--max-orders": "N", "--show": "N"}),
    "bench": ("FILE", {"--book": "fast|reference|decode", "--cpu": "N", "--max-orders": "N", "--no-latency": ""}),
    "pipeline": ("FILE", {"--feed-cpu": "N", "--strategy-cpu": "N", "--out": "PATH", "--max-orders": "N"}),
    "gen": ("OUTPUT", {"--messages": "N", "--symbols": "N", "--seed": "N"}),
}
#: Options without a meaning here, as Spark places its tasks and books grow as they need: taken and ignored.
IGNORED = ("--max-orders", "--cpu", "--feed-cpu", "--strategy-cpu")
Report = list[tuple[str, str]]


class Usage(Exception):
    pass


def usage(command: str) -> str:
    what, options = OPTIONS[command]
    return f"usage: lobspark {command} {what} [options]\n" + "".join(f"  {' '.join(filter(None, o))}{'  (ignored)' if o[0] in IGNORED else ''}\n" for o in options.items())


def parse_count(flag: str, value: str | None) -> int:
    """A base-10 number without anything around it."""
    if value is None:
        raise ValueError(f"{flag} needs a value")
    if not (value.isascii() and value.isdigit()) or int(value) >= 1 << 64:
        raise ValueError(f"invalid value for {flag}: {value}")
    return int(value)


def parsed(command: str, args: list[str]) -> tuple[str | None, dict]:
    """The file (None: the help is asked for) and the options."""
    path, found, rest = "", {}, list(args)
    options = OPTIONS[command][1]
    while rest:
        arg = rest.pop(0)
        if arg in ("-h", "--help"):
            return None, {}
        if not arg.startswith("-"):
            path = arg
        elif arg not in options:
            raise ValueError(f"unknown option {arg}")
        elif not options[arg]:
            found[arg] = True
        else:
            value = rest.pop(0) if rest else None
            if options[arg] == "N":
                found[arg] = parse_count(arg, value)
            elif value is None:
                raise ValueError(f"{arg} needs a path" if options[arg] == "PATH" else f"{arg} takes {options[arg]}")
            elif "|" in options[arg] and value not in options[arg].split("|"):
                raise ValueError(f"{arg} takes {options[arg].replace('|', ', ')}")
            else:
                found[arg] = value
    if not path:
        raise Usage(usage(command))
    return path, found


def commas(n: int) -> str:
    return f"{n:,}"


def size_text(n: int) -> str:
    return f"{n / 1e9:.2f} GB" if n >= 10**9 else f"{n / 1e6:.1f} MB"


def quote(price: int, qty: int, orders: int) -> str:
    return f"{commas(qty)} @ {price // 10000}.{price % 10000:04d} ({orders} orders)" if qty else "none"


def clock(ns: int) -> str:
    s, rest = divmod(ns, 10**9)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{rest:09d}"


def file_report(spark: SparkSession, path: str, frames: DataFrame) -> tuple[Report, int, int]:
    """Lines on the file; its messages and how many are malformed."""
    row = stats.feed_summary(frames.withColumn("locate", F.conv(F.hex(F.substring("payload", 2, 2)), 16, 10).cast("int"))).first()
    size = sum(n for _, n in feed._files(path))
    symbols = session.directory(feed.messages(frames)).filter("name <> ''").count()
    out = [("file", path), ("size", f"{size_text(size)}, {commas(row['messages'])} messages, {commas(symbols)} symbols")]
    trailing = size - (row["bytes"] or 0)
    if trailing:
        out.append(("warning", f"{commas(trailing)} trailing bytes hold no whole message and are left out"))
    if row["malformed"]:
        out.append(("warning", f"{commas(row['malformed'])} messages are shorter than their type"))
    return out, row["messages"], row["malformed"]


def anomaly_text(row) -> str:
    names = ("unknown_order", "duplicate_order", "zero_shares", "overfill", "bad_locate")
    return f"{commas(sum(row[n] for n in names))} ({', '.join(f'{n.replace('_', ' ')} {commas(row[n])}' for n in names)})"


def counted(folded: DataFrame):
    names = ("unknown_order", "duplicate_order", "zero_shares", "overfill", "bad_locate")
    return folded.agg(F.count("*").alias("events"), *[F.count_if(F.col("anomaly") == n).alias(n) for n in names]).first()


def verify(spark: SparkSession, path: str, options: dict) -> tuple[Report, bool]:
    """The fold against the relational book on feeds without anomalies; on others their anomalies are told, and both can't be compared."""
    frames = feed.read_feed(spark, path)
    out, messages, malformed = file_report(spark, path, frames)
    began = time.time()
    m, show = feed.messages(frames).persist(), options.get("--show", 10)
    folded = book.replay(m).persist()
    row = counted(folded)
    clean = not sum(row[n] for n in ("unknown_order", "duplicate_order", "zero_shares", "overfill", "bad_locate"))
    key = ["trade_date", "locate", "off"]
    mismatches, live = 0, [("live orders", "not compared")]
    if clean:
        left, right = folded.select(*key, F.struct(*book.TOP).alias("x")), book.top_relational(m).select(*key, F.struct(*book.TOP).alias("y"))
        apart = left.join(right, key, "full").filter(~F.col("x").eqNullSafe(F.col("y")))
        mismatches = apart.count()
        for r in apart.orderBy("trade_date", "off").limit(show).collect():
            out.append(("mismatch", f"offset {r['off']} locate {r['locate']}: fold {tuple(r['x'] or ())}, relational {tuple(r['y'] or ())}"))
        days = book.live_orders(m).collect()
        live = [("live orders", f"{commas(sum(d['live_end'] for d in days))} at end of feed (peak {commas(max((d['live_peak'] for d in days), default=0))})")]
    crossed = session.named(session.crossed(folded, m), m)
    for r in crossed.orderBy("trade_date", "off").limit(show).collect():
        out.append(("crossed", f"offset {commas(r['off'])} {r['symbol']} {clock(r['ts_ns'])}: bid {quote(r['bid_px'], r['bid_qty'], r['bid_orders'])}, ask {quote(r['ask_px'], r['ask_qty'], r['ask_orders'])}"))
    out += [
        ("replay", f"{commas(messages)} messages in {time.time() - began:.2f} s"),
        ("compared", f"{commas(row['events'] if clean else 0)} order events: {commas(mismatches)} mismatches"),
        ("anomalies", anomaly_text(row)),
        *live,
        ("crossed", f"{commas(crossed.count())} order events left a trading symbol locked or crossed in market hours"),
    ]
    good = mismatches == 0 and malformed == 0
    return [*out, ("result", "PASS" if good else "FAIL")], good


def bench(spark: SparkSession, path: str, options: dict) -> tuple[Report, bool]:
    """Throughput of a replay into the fold ("fast"), the relational book ("reference") or of decoding; then gaps between messages by type."""
    frames = feed.read_feed(spark, path)
    out, messages, _ = file_report(spark, path, frames)
    if not messages:
        return out, True
    m, mode = feed.messages(frames).persist(), options.get("--book", "fast")
    m.count()  # nothing but the replay is timed
    run = {"fast": lambda: book.replay(m), "reference": lambda: book.top_relational(m), "decode": lambda: stats.decode_checksum(feed.messages(frames))}[mode]
    began = time.time()
    run().write.format("noop").mode("overwrite").save()
    s = time.time() - began
    out += [("book", {"decode": "none (decode only)"}.get(mode, mode)), ("throughput", f"{messages / s / 1e6:.2f} M msg/s, {s * 1e9 / messages:.1f} ns/msg, {s:.2f} s")]
    if mode == "decode":
        out += [("checksum", f"{r['trade_date']} {r['checksum']}") for r in run().orderBy("trade_date").collect()]
    elif mode == "fast":
        row, days = counted(run()), book.live_orders(m).collect()
        out.append(("orders", f"peak {commas(max((d['live_peak'] for d in days), default=0))} live, {commas(sum(d['live_end'] for d in days))} at end, anomalies {anomaly_text(row)}"))
    if not options.get("--no-latency"):
        w = F.lag("ts_ns").over(book.W.partitionBy("trade_date", "locate").orderBy("off"))
        gaps = m.withColumn("gap", F.col("ts_ns") - w).filter("gap >= 0")
        qs = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p99_9": 0.999, "p99_99": 0.9999}
        for r in stats.quantiles(gaps, ["type"], "gap", qs, total="all").orderBy(F.desc("n"), F.col("type") != "all", "type").collect():
            out.append(("gap ns", f"{r['type']} {wire.NAMES.get(r['type'], '')} {commas(r['n'])} " + " ".join(f"{q.replace('_', '.')} {r[q]}" for q in (*qs, "max"))))
    return out, True


def pipeline(spark: SparkSession, path: str, options: dict) -> tuple[Report, bool]:
    """Order flow imbalance for each symbol and minute, and with --out as CSV."""
    frames = feed.read_feed(spark, path)
    out, messages, _ = file_report(spark, path, frames)
    began = time.time()
    m = feed.messages(frames).persist()
    changes = book.replay(m, changes=True).persist()
    rows = session.imbalance(changes, m).persist()
    updates, minutes = changes.count(), rows.count()
    s = time.time() - began
    out += [("feed", f"{commas(messages)} messages in {s:.2f} s ({messages / s / 1e6:.2f} M msg/s), {commas(updates)} top of book updates"), ("ofi", f"{commas(minutes)} symbol-minutes in regular hours")]
    if "--out" in options:
        feed.write_csv(session.named(rows, m), options["--out"])
        out.append(("wrote", options["--out"]))
    return out, True


def gen(spark: SparkSession, path: str, options: dict) -> tuple[Report, bool]:
    """A synthetic day as a feed file in a folder."""
    symbols = options.get("--symbols", 64)
    if not 1 <= symbols <= 65535:
        raise ValueError("--symbols must be from 1 to 65535")
    feed.write_feed(synthetic.generate(spark, options.get("--messages", 5_000_000), symbols, options.get("--seed", 1)), path)
    frames = feed.read_feed(spark, path)
    n, days = frames.count(), book.live_orders(feed.messages(frames)).collect()
    left = sum(d["live_end"] for d in days)
    return [("wrote", f"{path}: {commas(n)} messages, {size_text(sum(s for _, s in feed._files(path)))}, {commas(symbols)} symbols, {commas(left)} orders left open")], True


COMMANDS: dict[str, Callable[[SparkSession, str, dict], tuple[Report, bool]]] = {"verify": verify, "bench": bench, "pipeline": pipeline, "gen": gen}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    if not argv or argv[0] not in COMMANDS:
        print("".join(map(usage, COMMANDS)), end="", file=sys.stderr)
        return 2
    try:
        path, options = parsed(argv[0], argv[1:])
        if path is None:
            print(usage(argv[0]), end="")
            return 0
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        lines, good = COMMANDS[argv[0]](spark, path, options)
    except Usage as e:
        print(e, end="", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for name, text in lines:
        print(f"{name:<12} {text}")
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
