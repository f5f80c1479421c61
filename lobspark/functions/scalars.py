"""Scalar functions of prices, times and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side_code(letter: Column) -> Column:
    return F.when(letter == "S", 1).otherwise(0)


def tick_of(price: Column) -> Column:
    """Index on the tick grid: tenths of a mill below a dollar, cents above; null off the grid."""
    return F.when(price < 10000, price).when(price % 100 != 0, F.lit(None)).otherwise(F.lit(10000) + F.floor((price - 10000) / 100)).cast("long")


def price_of(tick: Column) -> Column:
    return F.when(tick < 10000, tick).otherwise(F.lit(10000) + (tick - 10000) * 100).cast("long")


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / F.lit(20000.0)


def minute_of(ts_ns: Column) -> Column:
    return F.floor(ts_ns / F.lit(60_000_000_000)).cast("long")


def clock(ts_ns: Column) -> Column:
    """HH:MM:SS.nnnnnnnnn"""
    s = F.floor(ts_ns / 1_000_000_000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("."), F.lpad((ts_ns % 1_000_000_000).cast("string"), 9, "0"))


def hh_mm(minute: Column) -> Column:
    return F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))


def dollars(price: Column) -> Column:
    return F.concat(F.floor(price / 10000).cast("string"), F.lit("."), F.lpad((price % 10000).cast("string"), 4, "0"))


def quote_text(price: Column, qty: Column, orders: Column) -> Column:
    """One side of a quote for reports; "none" without quantity."""
    some = F.concat(commas(qty), F.lit(" @ "), dollars(price), F.lit(" ("), orders.cast("string"), F.lit(" orders)"))
    return F.when(qty == 0, "none").otherwise(some)


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def elapsed(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


LINEAR, LINEAR_BITS, SUB_BITS = 1024, 10, 6  # fixed: exact buckets below 1024, then 64 for each power of two


def bucket(value: Column) -> Column:
    """Log-linear histogram bucket of a value of at least 0."""
    value = value.cast("long")
    e = F.length(F.bin(value)) - 1
    sub = F.call_function("shiftright", value, (e - SUB_BITS).cast("int")).bitwiseAND(F.lit(63))
    return F.when(value < LINEAR, value).otherwise(LINEAR + (e - LINEAR_BITS) * 64 + sub).cast("long")


def bucket_edge(b: Column) -> Column:
    """Largest value of a bucket."""
    i = b - LINEAR
    shift = (F.floor(i / 64) + LINEAR_BITS - SUB_BITS).cast("int")
    return F.when(b < LINEAR, b).otherwise(F.call_function("shiftleft", (64 + i % 64 + 1).cast("long"), shift) - 1).cast("long")


def byte_text(n: Column) -> Column:
    """Decimal gigabytes or megabytes; rounds the exact binary value, as C does."""
    text = lambda x, digits: F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
    return F.when(n >= 1_000_000_000, F.concat(text(n / F.lit(1e9), 2), F.lit(" GB"))).otherwise(F.concat(text(n / F.lit(1e6), 1), F.lit(" MB")))
