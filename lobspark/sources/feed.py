"""Binary feed files: length-framed messages, one file for each trading day, read and written through Spark.

`spark.read.format("lobfeed").load(path)` gives frames (file, size, off, len, payload). A file ends at its first zero
length, at a frame that exceeds it or with fewer than two bytes left; what follows is told by `trailing_bytes`.
Files larger than `split_bytes` are read in ranges. A range starts where a chain of plausible frames starts, which its
own task and the task before it seek, not the driver; a reader whose own chain doesn't end exactly at the next range's
start fails, so a wrong guess can't give wrong rows. `split_bytes=0` reads each file whole. With `types`, a string of
type letters, frames of other types leave the reader neither as rows nor as payloads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import wire
from ..functions.scalars import side_code

SCHEMA = "file string, size long, off long, len int, payload binary"
SPLIT = 64 << 20
CHUNK = 4 << 20
WINDOW = 1 << 17  # bytes in which a range's start is sought; longer than any frame
CHAIN = 32  # plausible frames that follow a start


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else "file://" + path)


def _files(path: str) -> list[tuple[str, int]]:
    fs, at = _fs(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"open failed for {path}: no such file")
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted((path.rstrip("/") + "/" + f.base_name, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def _plausible(data: bytes, at: int) -> bool:
    """Whether frames of known types and their own sizes follow one another from `at`."""
    for _ in range(CHAIN):
        if at + 3 > len(data):
            return True
        n = data[at] << 8 | data[at + 1]
        if wire.SIZES.get(chr(data[at + 2])) != n:
            return False
        at += 2 + n
    return True


@dataclass
class Range(InputPartition):
    file: str
    size: int
    cuts: list[int]  # where this range is sought, and the ranges after it


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT))
        self.types = frozenset(map(ord, options.get("types", "")))

    def partitions(self) -> list[Range]:
        out = []
        for file, size in _files(self.path):
            step = self.split or max(1, size)
            out += [Range(file, size, [cut, step]) for cut in range(0, max(1, size), step)]
        return out

    @staticmethod
    def _start(f, size: int, cut: int) -> int | None:
        """Where the range of a cut starts; None if no frame is found to start near it."""
        if cut == 0:
            return 0
        data = f.read_at(min(WINDOW, size - cut), cut)
        found = next((k for k in range(len(data) // 2) if _plausible(data, k)), None)
        return None if found is None else cut + found

    def _bounds(self, f, p: Range) -> tuple[int, int] | None:
        """Where a range starts and where the next one does; None for a range without a start of its own."""
        cut, step = p.cuts
        start = self._start(f, p.size, cut)
        if cut and start is not None and cut - step > 0 and self._start(f, p.size, cut - step) == start:
            start = None  # the range before starts there too
        if start is None:
            return None
        for later in range(cut + step, p.size, step):
            end = self._start(f, p.size, later)
            if end is not None and end > start:
                return start, end
        return start, p.size

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, types = partition, self.types
        fs, path = _fs(p.file)
        with fs.open_input_file(path) as f:
            if p.cuts[0] == 0 and f.read_at(min(2, p.size), 0) == b"\x1f\x8b":
                raise ValueError(f"input is gzip-compressed: {p.file}")
            bounds = self._bounds(f, p)
            if bounds is None:
                return
            begin, stop = bounds
            base, data, at, ended = begin, b"", 0, False
            while base + at < stop and not ended:
                base, data, at = base + at, f.read_at(min(CHUNK, p.size - base - at), base + at), 0
                offs, lens, loads, total = [], [], [], len(data)
                while base + at < stop:
                    if at + 2 > total:
                        ended = base + total >= p.size
                        break
                    n = data[at] << 8 | data[at + 1]
                    if n == 0 or base + at + 2 + n > p.size:
                        ended = True
                        break
                    if at + 2 + n > total:
                        break
                    if not types or data[at + 2] in types:
                        offs.append(base + at)
                        lens.append(n)
                        loads.append(data[at + 2 : at + 2 + n])
                    at += 2 + n
                if offs:
                    k = len(offs)
                    yield pa.RecordBatch.from_arrays([pa.array([p.file] * k), pa.array([p.size] * k, pa.int64()), pa.array(offs, pa.int64()), pa.array(lens, pa.int32()), pa.array(loads, pa.binary())], ["file", "size", "off", "len", "payload"])
            if stop < p.size and base + at != stop:
                raise ValueError(f"{p.file}: frames from {begin} don't meet the range at {stop}; read it with split_bytes=0")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FeedWriter(DataSourceWriter):
    """Rows (trade_date, off, payload), of which a task holds whole days in order: one file `<date>.feed` a day.

    Tasks write under names of their own; the driver renames what succeeded, so repeated attempts leave no trace.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(root)
        files, day, out, seen = [], None, None, set()
        for row in rows:
            if row["trade_date"] != day or out is None:
                if out is not None:
                    out.close()
                day = row["trade_date"]
                if day in seen:
                    raise ValueError(f"rows of {day} aren't together; write feeds with write_feed")
                seen.add(day)
                name = f"{root}/.{day}-{uuid.uuid4().hex}"
                files.append((name, f"{root}/{day}.feed"))
                out = fs.open_output_stream(name)
            load = bytes(row["payload"])
            if not 0 < len(load) < 1 << 16:
                raise ValueError("a frame holds 1 to 65535 bytes")
            out.write(len(load).to_bytes(2, "big") + load)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, _ = _fs(self.path)
        for temporary, final in (x for m in messages if m for x in m.files):
            fs.move(temporary, final)

    def abort(self, messages: list) -> None:
        fs, _ = _fs(self.path)
        for temporary, _ in (x for m in messages if m for x in m.files):
            fs.delete_file(temporary)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lobfeed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def writer(self, schema, overwrite: bool) -> FeedWriter:
        return FeedWriter(self.options)


def read_feed(spark: SparkSession, path: str, split_bytes: int = SPLIT, types: str = "") -> DataFrame:
    """Frames (of some types, if given) with trade_date, taken from a date in each file's name (null without one), and type."""
    spark.dataSource.register(FeedSource)
    rows = spark.read.format("lobfeed").option("split_bytes", split_bytes).option("types", types).load(path)
    day = F.regexp_replace(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    return rows.withColumn("trade_date", F.to_date(F.nullif(day, F.lit("")), "yyyyMMdd")).withColumn("type", F.decode(F.substring("payload", 1, 1), "ISO-8859-1"))


def write_feed(rows: DataFrame, path: str) -> None:
    """Rows (trade_date, off, payload) as one file a day, in order of off. A day is one task's, as its file has one order; the sort may spill."""
    rows.sparkSession.dataSource.register(FeedSource)
    rows = rows.select("trade_date", "off", "payload").repartition("trade_date").sortWithinPartitions("trade_date", "off")
    rows.write.format("lobfeed").mode("append").save(path)


def trailing_bytes(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """file, trailing: bytes after each file's last whole frame."""
    files = spark.createDataFrame(_files(path), "file string, size long")
    ends = read_feed(spark, path, split_bytes).groupBy("file").agg(F.max(F.col("off") + 2 + F.col("len")).alias("end"))
    return files.join(ends, "file", "left").select("file", (F.col("size") - F.coalesce("end", F.lit(0))).alias("trailing"))


def _field(t: str, name: str):
    return next((f for f in wire.FIELDS[t] if f[0] == name), None)


def table(frames: DataFrame, kind: str) -> DataFrame:
    """All fields of the whole messages of one type: trade_date, off, then the fields in the format's order."""
    whole = frames.filter((F.col("type") == kind) & (F.col("len") >= wire.SIZES[kind]))
    return whole.select("trade_date", "off", *wire.decode(F.col("payload"), kind))


def wide(frames: DataFrame) -> DataFrame:
    """Every field of every type, one column a name, null where a type lacks it; unknown types keep only their type.

    Fields of eight bytes are decimal(20,0), others bigint, text keeps its padding. Frames shorter than their type are
    left out.
    """
    size = wire.spec_size(F.col("type"))
    known = frames.filter((size == 0) | (F.col("len") >= size))
    places: dict[str, dict[tuple, list[str]]] = {}
    for t in wire.SIZES:
        for name, *where in wire.FIELDS[t]:
            places.setdefault(name, {}).setdefault(tuple(where), []).append(t)
    cells = []
    for name, of in places.items():
        cell, eight = F.lit(None), any(width == 8 for _, width, what in of if what == "u")
        for (at, width, what), ts in of.items():
            value = F.decode(F.substring("payload", at + 1, width), "US-ASCII") if what == "c" else wire.unsigned(F.col("payload"), at, width).cast("decimal(20,0)" if eight else "long")
            cell = F.when(F.col("type").isin(*ts), value).otherwise(cell)
        cells.append(cell.alias(name))
    return known.select("trade_date", "off", "type", *cells)


def messages(frames: DataFrame) -> DataFrame:
    """Frames as messages: trade_date, off, type, locate, ts_ns, ref, new_ref, side, shares, price, stock, code.

    Frames shorter than their type and unknown types are left out. References keep their 64 bits as a signed long.
    """
    known = frames.filter((wire.spec_size(F.col("type")) > 0) & (F.col("len") >= wire.spec_size(F.col("type"))))
    signed = lambda at, width: F.conv(F.hex(F.substring("payload", at + 1, width)), 16, -10).cast("long")

    def cell(name: str, types: dict[str, str] | None = None):
        out = F.lit(None)
        groups: dict[tuple, list[str]] = {}
        for t in wire.SIZES:
            if f := _field(t, (types or {}).get(t, "" if types else name)):
                groups.setdefault(f[1:], []).append(t)
        for (at, width, what), ts in groups.items():
            value = signed(at, width) if what == "u" else F.decode(F.substring("payload", at + 1, width), "US-ASCII")
            out = F.when(F.col("type").isin(*ts), value).otherwise(out)
        return out

    side = cell("side")
    return known.select(
        "trade_date", "off", "type", signed(1, 2).cast("int").alias("locate"), signed(5, 6).alias("ts_ns"), cell("ref").alias("ref"), cell("new_ref").alias("new_ref"),
        F.when(side.isNotNull(), side_code(side)).alias("side"), cell("shares").alias("shares"), cell("price").alias("price"), cell("stock").alias("stock"),
        cell("", {"S": "event_code", "H": "trading_state"}).alias("code"),
    )


def encoded(messages: DataFrame) -> DataFrame:
    """Messages as (trade_date, off, payload); fields that messages lack are zeros or spaces."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    values = {c: zero(c) for c in ("locate", "ts_ns", "ref", "new_ref", "shares", "price")}
    text = F.coalesce("code", F.lit(""))
    values |= {"side": F.when(F.col("side") == 1, "S").otherwise("B"), "stock": F.coalesce("stock", F.lit("")), "event_code": text, "trading_state": text}
    payload = F.lit(None).cast("binary")
    for t in wire.SIZES:
        payload = F.when(F.col("type") == t, wire.encode(t, values)).otherwise(payload)
    return messages.select("trade_date", "off", payload.alias("payload"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Order flow imbalance (with locate, symbol, minute, first) as CSV, sorted by locate, minute and, as a halt may split a minute, first; mids have four digits, rounded as C does."""
    text = lambda c: F.replace(F.format_number(c, 4), F.lit(","), F.lit(""))
    clock = F.concat(F.lpad(F.floor(F.col("minute") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("minute") % 60).cast("string"), 2, "0"))
    out = rows.select("trade_date", "locate", F.col("minute").alias("m"), "symbol", clock.alias("minute"), "ofi", "events", text("mid_open").alias("mid_open"), text("mid_close").alias("mid_close"), "first")
    out = out.repartition("trade_date").sortWithinPartitions("trade_date", "locate", "m", "first")  # a file a day, of a row a symbol and minute
    out.drop("locate", "m", "first").write.mode("overwrite").partitionBy("trade_date").option("header", True).csv(path)
