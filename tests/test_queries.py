"""Every query of the library against its SQL oracle on the smallest tables."""

import duckdb
import pytest

from lobspark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=str)


def test_crosscheck_without_joins_by_ranges(spark):
    """Events that meet every level of their symbol's day grow with the square of the day."""
    plan = QUERIES["tob_crosscheck"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not [line for line in plan.splitlines() if "Join" in line and "<" in line.replace("<=>", "")]


def test_crosscheck_makes_messages_once(spark):
    """Both books read messages that were written; neither makes them from the events again."""
    files = QUERIES["tob_crosscheck"](spark, SF).inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]


def test_depth_joins_replaced_orders_alone(spark):
    """What is left of an order, its price and side come from one window; only what replaces made meets their chains' first orders."""
    plan = QUERIES["level_running_depth"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 2
