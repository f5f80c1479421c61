"""Order-book messages in closed form from the `events` table, one trading day for each date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NS = {
    "spark": "(hour(ts) * 3600000000000 + minute(ts) * 60000000000 + cast(extract(SECOND FROM ts) * 1000000 AS bigint) * 1000)",
    "duckdb": "((epoch_us(ts) % 86400000000) * 1000)",
}
_COLUMNS = ("trade_date", "off", "type", "locate", "ts_ns", "ref", "new_ref", "side", "shares", "price", "stock", "code")


def _part(where: str, **values: str) -> str:
    kinds = {"type": "varchar(1)", "stock": "varchar(16)", "code": "varchar(1)", "locate": "int", "side": "int"}
    cells = [f"{values[c]} AS {c}" if c in ("trade_date",) else f"CAST({values.get(c, 'NULL')} AS {'string' if kinds.get(c, '').startswith('varchar') else kinds.get(c, 'bigint')}) AS {c}" for c in _COLUMNS]
    return f"SELECT {', '.join(cells)} FROM o WHERE {where}"


def sql(dialect: str, events: str, anomalies: bool = False) -> str:
    """The messages as one query in Spark's or DuckDB's SQL."""
    base = {"trade_date": "trade_date", "locate": "locate"}
    at = lambda i, n, slot: base | {"off": f"16 * ({i} + 1) + {slot}", "ts_ns": n}
    parts = [
        _part("true", **at("id", "ns", 0), type="CASE WHEN id % 13 = 0 THEN 'F' ELSE 'A' END", ref="ref", side="side", shares="shares", price="price", stock="stock"),
        _part("i2 IS NOT NULL", **at("i2", "n2", 1), type="'E'", ref="ref", shares="100"),
        _part("i3 IS NOT NULL AND id % 3 = 0 AND shares >= 300", **at("i3", "n3", 2), type="'X'", ref="ref", shares="50"),
        _part("i3 IS NOT NULL AND id % 11 = 0 AND shares >= 300", **at("i3", "n3", 3), type="'C'", ref="ref", shares="100", price="price + 100"),
        _part("i4 IS NOT NULL AND id % 5 = 0 AND shares >= 300", **at("i4", "n4", 4), type="'U'", ref="ref", new_ref="8 * id + 2", shares="200", price="price + 100"),
        _part("i6 IS NOT NULL AND shares >= 200 AND NOT (id % 5 = 0 AND shares >= 300)", **at("i6", "n6", 5), type="'D'", ref="ref"),
        _part("i6 IS NOT NULL AND id % 5 = 0 AND shares >= 300", **at("i6", "n6", 5), type="'D'", ref="8 * id + 2"),
        _part("kind = 'purchase'", **at("id", "ns", 6), type="'P'", side="side", shares="shares", price="price", stock="stock"),
        _part("kind = 'signup'", **at("id", "ns", 7), type="CASE WHEN id % 2 = 0 THEN 'Q' ELSE 'B' END", shares="shares"),
        _part("kind = 'error' AND id % 7 = 0", **at("id", "ns", 8), type="'H'", stock="stock", code="'H'"),
        _part("kind = 'error' AND id % 7 = 0 AND i2 IS NOT NULL", **at("i2", "n2", 9), type="'H'", stock="stock", code="'T'"),
        "SELECT trade_date, CAST(locate AS bigint) AS off, 'R' AS type, locate, CAST(0 AS bigint) AS ts_ns, CAST(NULL AS bigint) AS ref, CAST(NULL AS bigint) AS new_ref, CAST(NULL AS int) AS side, CAST(NULL AS bigint) AS shares, CAST(NULL AS bigint) AS price, max(stock) AS stock, CAST(NULL AS string) AS code FROM o WHERE locate <> 8 GROUP BY trade_date, locate",
    ]
    for code, hour in (("Q", 9.5), ("M", 16)):
        ns = int(hour * 3600) * 1_000_000_000
        parts.append(f"SELECT trade_date, 16 * (min(id) + 1) - 1 AS off, 'S' AS type, 0 AS locate, CAST({ns} AS bigint) AS ts_ns, CAST(NULL AS bigint) AS ref, CAST(NULL AS bigint) AS new_ref, CAST(NULL AS int) AS side, CAST(NULL AS bigint) AS shares, CAST(NULL AS bigint) AS price, CAST(NULL AS string) AS stock, '{code}' AS code FROM o WHERE ns >= {ns} GROUP BY trade_date")
    if anomalies:
        parts += [
            _part("id % 41 = 0", **at("id", "ns", 10), type="'E'", ref="8 * id + 7", shares="100"),
            _part("id % 43 = 0", **at("id", "ns", 11), type="'A'", ref="ref", side="side", shares="shares", price="price", stock="stock"),
            _part("id % 47 = 0", **at("id", "ns", 12), type="'A'", ref="8 * id + 5", side="side", shares="0", price="price", stock="stock"),
            _part("id % 53 = 0", **at("id", "ns", 13), type="'A'", ref="8 * id + 6", side="side", shares="100", price="price", stock="stock"),
            _part("id % 53 = 0", **at("id", "ns", 14), type="'E'", ref="8 * id + 6", shares="5000"),
            _part("id % 59 = 0", **at("id", "ns", 15) | {"locate": "100"}, type="'A'", ref="8 * id + 4", side="side", shares="100", price="price", stock="stock"),
        ]
    return f"""
WITH e AS (SELECT event_id AS id, CAST(ts AS date) AS trade_date, CAST({_NS[dialect]} AS bigint) AS ns, CAST(1 + user_id % 8 AS int) AS locate, event_type AS kind, CAST(floor(abs(value)) AS bigint) AS v FROM {events}),
l AS (SELECT *, lead(id, 2) OVER w AS i2, lead(ns, 2) OVER w AS n2, lead(id, 3) OVER w AS i3, lead(ns, 3) OVER w AS n3, lead(id, 4) OVER w AS i4, lead(ns, 4) OVER w AS n4, lead(id, 6) OVER w AS i6, lead(ns, 6) OVER w AS n6 FROM e WINDOW w AS (PARTITION BY trade_date, locate ORDER BY id)),
p AS (SELECT *, CASE WHEN id % 97 = 0 AND id % 2 = 0 THEN 93000 WHEN id % 2 = 0 THEN 90000 + 100 * (v % 20) ELSE 92100 + 100 * ((v + id) % 20) END + CASE WHEN id % 50 = 0 THEN 50 ELSE 0 END AS raw FROM l),
o AS (SELECT *, 8 * id + 1 AS ref, CAST(id % 2 AS int) AS side, 100 * (1 + id % 7) AS shares, CASE WHEN locate = 3 THEN CAST(floor(raw / 10) AS bigint) ELSE raw END AS price, concat('SYM', CAST(locate AS string)) AS stock FROM p)
{' UNION ALL '.join(parts)}"""


def messages(spark: SparkSession, sf_dir: str, anomalies: bool = False) -> DataFrame:
    """trade_date, off, type, locate, ts_ns, ref, new_ref, side, shares, price, stock, code (of S and H)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(sql("spark", "{events}", anomalies), events=events)
