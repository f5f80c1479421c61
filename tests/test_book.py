"""Book rules on small feeds, the fold against a plain model and against the relational plan."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lobspark.functions import wire
from lobspark.operators.book import Book


def px(dollars: float) -> int:
    return round(dollars * 10000)


def test_sizes():
    want = dict(S=12, R=39, H=25, Y=20, L=26, V=35, W=12, K=28, J=35, h=21, A=36, F=40, E=31, C=36, X=23, D=19, U=35, P=44, Q=40, B=19, I=50, N=20, O=48)
    assert wire.SIZES == want
    for kind, fields in wire.FIELDS.items():
        assert fields[-1][1] + fields[-1][2] == wire.SIZES[kind]


def test_orders_at_one_price_aggregate():
    b = Book()
    for ref, side, shares, price in ((1, 0, 100, 10.0), (2, 0, 200, 10.0), (3, 0, 300, 9.99), (4, 1, 50, 10.02)):
        assert b.add(ref, side, shares, px(price)) == ""
    assert b.best(0) == (100000, 2, 300) and b.best(1) == (100200, 1, 50)
    assert Book().best(0) == (0, 0, 0)


def test_reduce_cancel_delete():
    b = Book()
    b.add(1, 1, 300, px(20.05))
    b.add(2, 1, 100, px(20.06))
    b.apply("E", 1, 0, 0, 100, 0)
    b.apply("X", 1, 0, 0, 50, 0)
    assert b.best(1) == (200500, 1, 150)
    b.apply("E", 1, 0, 0, 150, 0)
    assert b.best(1)[0] == 200600
    b.apply("D", 2, 0, 0, 0, 0)
    assert b.best(1) == (0, 0, 0) and not b.orders


def test_replace_keeps_side():
    b = Book()
    b.add(1, 0, 100, px(50))
    assert b.replace(1, 2, 400, px(50.1)) == ""
    assert b.best(0) == (501000, 1, 400) and b.reduce(1, 5) == "unknown_order"
    assert b.replace(2, 2, 10, px(50.2)) == "" and b.best(0) == (502000, 1, 10)


def test_anomalies():
    b = Book()
    found = [b.add(1, 0, 100, px(5)), b.add(1, 0, 100, px(5)), b.add(2, 0, 0, px(5)), b.reduce(99, 1), b.reduce(98, None), b.replace(97, 3, 1, 1), b.reduce(1, 150)]
    assert found == ["", "duplicate_order", "zero_shares", "unknown_order", "unknown_order", "unknown_order", "overfill"]
    assert b.best(0) == (0, 0, 0) and not b.orders


def test_far_levels():
    b = Book()
    for ref, side, shares, price in ((1, 0, 100, 100), (2, 0, 200, 40), (3, 1, 300, 100.05), (4, 1, 400, 190)):
        b.add(ref, side, shares, px(price))
    b.reduce(1, None)
    assert b.best(0)[0] == px(40)
    b.reduce(3, None)
    assert b.best(1)[0] == px(190)
    b.add(5, 0, 500, px(185))
    b.reduce(5, None)
    assert b.best(0) == (px(40), 1, 200)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30))
def test_random_flow_against_plain_model(seed):
    rng, b, orders = random.Random(seed), Book(), {}
    for _ in range(300):
        kind, ref, new, side, shares, price = rng.choice("AAAAECXDU"), rng.randrange(30), rng.randrange(30), rng.randrange(2), rng.randrange(0, 6), rng.randrange(90, 110)
        b.apply(kind, ref, new, side, shares, price)
        if kind == "A":
            if shares and ref not in orders:
                orders[ref] = [side, price, shares]
        elif ref in orders:
            if kind in "ECX":
                orders[ref][2] -= min(shares, orders[ref][2])
                if not orders[ref][2]:
                    del orders[ref]
            else:
                s = orders.pop(ref)[0]
                if kind == "U" and shares and new not in orders:
                    orders[new] = [s, price, shares]
        for s in (0, 1):
            prices = [p for k, p, _ in orders.values() if k == s]
            top = (max(prices) if s == 0 else min(prices)) if prices else 0
            at = [q for k, p, q in orders.values() if k == s and p == top]
            assert b.best(s) == (top, len(at), sum(at))
