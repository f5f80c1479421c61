"""Synthetic trading days: for tests and benches, deterministic by (seed, day, symbol).

Each symbol's day is made by itself from a seed of its own, so days and symbols are made in parallel. A message's `off`
is its nanosecond and locate in one number, which orders a day without a shuffle; files get byte offsets on reading.
Symbols are picked with a square skew: the first ones have most messages.
"""

from __future__ import annotations

import datetime
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wire

SECOND = 1_000_000_000
OPEN, PAUSE, RESUME, CLOSE = (int(h * 3600) * SECOND for h in (9.5, 11, 11 + 1 / 12, 16))
FIRST, LAST = 4 * 3600 * SECOND, 20 * 3600 * SECOND
# fixed shares of the actions, in percent
MIX = {"add": 42, "delete": 32, "replace": 9, "cancel": 5, "execute": 5.5, "execute_price": 0.5, "trade": 1, "drift": 3.5, "jump": 0.02, "other": 1.48}
OTHER = "YLVWKJhQBINO"


def pack(kind: str, **values) -> bytes:
    """One payload: fields without a value take the format's defaults, else zeros or spaces."""
    values = wire.DEFAULTS.get(kind, {}) | values
    out = bytearray(b" " * wire.SIZES[kind])
    out[0:1] = kind.encode()
    for name, at, width, what in wire.FIELDS[kind]:
        v = values.get(name)
        out[at : at + width] = (v or 0).to_bytes(width, "big") if what == "u" else (v or "").encode()[:width].ljust(width)
    return bytes(out)


def symbol(i: int) -> str:
    return "T" + "".join(chr(65 + i // 26**k % 26) for k in (2, 1, 0))


def symbol_day(seed: int, day: int, i: int, count: int) -> Iterator[tuple[int, bytes]]:
    """(nanosecond, payload) of symbol i, in order, each at a nanosecond of its own; about `count` messages."""
    rng = random.Random(f"{seed}/{day}/{i}")
    locate, stock = i + 1, symbol(i)
    low, high, tick = (500, 8999, 1) if i % 8 == 3 else (5_000_000, 30_000_000, 100) if i % 8 == 5 else (50_000, 2_000_000, 100)
    mid = rng.randrange(low, high) // tick * tick
    live: dict[int, list[int]] = {}  # ref -> side, price, shares
    refs: list[int] = []
    made, names, weights = 0, list(MIX), list(MIX.values())
    head = {"locate": locate, "stock": stock}
    yield 3 * 3600 * SECOND + locate, pack("R", ts_ns=3 * 3600 * SECOND + locate, **head)
    yield 3 * 3600 * SECOND + 100_000 + locate, pack("H", ts_ns=3 * 3600 * SECOND + 100_000 + locate, trading_state="T", **head)
    marks = [(PAUSE, "H"), (RESUME, "T")] if i == 1 else []
    step = (LAST - FIRST) // max(1, count)

    def pick() -> int | None:
        while refs:
            at = rng.randrange(len(refs))
            if refs[at] in live:
                return refs[at]
            refs[at] = refs[-1]
            refs.pop()
        return None

    def price(side: int) -> int:
        away = tick * (1 + int(rng.expovariate(0.3))) if rng.random() < 0.98 else tick * rng.randrange(500, 5000)
        odd = 50 if tick == 100 and rng.random() < 0.002 else 0
        return min(4_000_000_000, max(1, (mid + away if side else mid - away) + odd))

    def new(side: int, shares: int, at: int) -> int:
        nonlocal made
        made += 1
        ref = locate << 40 | made
        live[ref] = [side, at, shares]
        refs.append(ref)
        return ref

    def fill(ref: int, shares: int) -> None:
        live[ref][2] -= shares
        if not live[ref][2]:
            del live[ref]

    for k in range(count):
        ts = FIRST + k * step + rng.randrange(max(1, step // 2))
        while marks and marks[0][0] <= ts:
            t, state = marks.pop(0)
            yield t, pack("H", ts_ns=t, trading_state=state, **head)
        head_ts = head | {"ts_ns": ts}
        act, ref = rng.choices(names, weights)[0], pick()
        if act in ("drift", "jump"):  # prices move; orders in the way are executed
            mid = min(max(low, mid + tick * rng.choice((-1, 1)) * (rng.randint(1, 3) if act == "drift" else rng.randrange(3000, 6000))), 2 * high)
            crossed = ref is not None and ((live[ref][1] <= mid) if live[ref][0] else (live[ref][1] >= mid))
            act = "execute" if crossed else "add"
        if act == "other":
            yield ts, pack(OTHER[k % len(OTHER)], **head_ts)
        elif act == "trade":
            yield ts, pack("P", side=rng.choice("BS"), shares=100, price=mid, match=k + 1, **head_ts)
        elif act == "add" or ref is None:
            side, shares = rng.randrange(2), 100 * rng.randint(1, 10) if rng.random() < 0.8 else rng.randint(1, 99)
            at = price(side)
            kind = "F" if rng.random() < 0.06 else "A"
            yield ts, pack(kind, ref=new(side, shares, at), side="BS"[side], shares=shares, price=at, attribution="MPID", **head_ts)
        elif act == "delete":
            del live[ref]
            yield ts, pack("D", ref=ref, **head_ts)
        elif act == "replace":
            side = live.pop(ref)[0]
            at, shares = price(side), 100 * rng.randint(1, 10)
            yield ts, pack("U", ref=ref, new_ref=new(side, shares, at), shares=shares, price=at, **head_ts)
        else:
            shares = rng.randint(1, live[ref][2])
            kind = {"cancel": "X", "execute": "E", "execute_price": "C"}[act]
            fill(ref, shares)
            yield ts, pack(kind, ref=ref, shares=shares, match=k + 1, printable="Y", price=mid, **head_ts)


def generate(spark: SparkSession, messages: int = 5_000_000, symbols: int = 64, seed: int = 1, days: int = 1, start: str = "2024-01-02") -> DataFrame:
    """trade_date, off, payload of `days` days with about `messages` messages each."""
    if not 1 <= symbols <= 65535:
        raise ValueError("symbols must be from 1 to 65535")
    first = datetime.date.fromisoformat(start)

    def system(day: int) -> Iterator[tuple[int, int, bytes]]:
        for ts, code in ((3 * 3600 * SECOND, "O"), (FIRST - 1, "S"), (OPEN, "Q"), (CLOSE, "M"), (LAST + 1, "E"), (LAST + 60 * SECOND, "C")):
            yield ts << 16, day, pack("S", ts_ns=ts, event_code=code)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for unit in part["id"].tolist():
                day, i = divmod(unit, symbols + 1)
                share = ((i + 1) / symbols) ** 0.5 - (i / symbols) ** 0.5 if i < symbols else 0
                rows, held = (system(day) if i == symbols else ((ts << 16 | i + 1, day, load) for ts, load in symbol_day(seed, day, i, round(messages * share)))), []
                for row in rows:
                    held.append(row)
                    if len(held) == 20_000:
                        yield frame(held)
                        held = []
                if held:
                    yield frame(held)

    def frame(held: list) -> pd.DataFrame:
        return pd.DataFrame({"trade_date": [first + datetime.timedelta(days=d) for _, d, _ in held], "off": [o for o, _, _ in held], "payload": [p for _, _, p in held]})

    units = days * (symbols + 1)
    return spark.range(0, units, 1, max(1, min(units, spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, "trade_date date, off long, payload binary")


def typed(rows: DataFrame) -> DataFrame:
    """Generated rows with the columns that `feed.messages` reads."""
    return rows.withColumn("type", F.decode(F.substring("payload", 1, 1), "US-ASCII")).withColumn("len", F.length("payload"))
