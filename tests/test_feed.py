"""Feed files through source and sink, the generator, and the stream against the batch plan."""

import pytest
from pyspark.sql import functions as F

from lobspark.operators import book, session
from lobspark.sources import bridge, feed, synthetic
from lobspark.streaming.imbalance import handoff, imbalance_stream

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def day(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "days")
    made = synthetic.generate(spark, 6000, 5, seed=3, days=2)
    feed.write_feed(made, path)
    return path, made


def test_round_trip_whole_and_in_ranges(spark, day):
    path, made = day
    want = rows(made.select("trade_date", "payload"))
    assert len(want) > 12000
    for split in (0, 50_000):
        got = feed.read_feed(spark, path, split)
        assert rows(got.select("trade_date", "payload")) == want
    assert feed.read_feed(spark, path, 50_000).rdd.getNumPartitions() > 2
    assert [r.trailing for r in feed.trailing_bytes(spark, path).collect()] == [0, 0]


def test_generator_has_no_anomalies(spark, day):
    m = feed.messages(feed.read_feed(spark, day[0]))
    assert book.replay(m).filter("anomaly <> ''").isEmpty()
    assert not session.imbalance(session.top_changes(book.replay(m)), m).isEmpty()
    assert rows(session.top_changes(book.replay(m))) == rows(book.replay(m, changes=True))


def test_tails_zero_lengths_and_gzip(spark, tmp_path):
    d = b"\x00\x13" + synthetic.pack("D", ref=(1 << 64) - 1)
    (tmp_path / "2024-01-02.a").write_bytes(d + d + b"\x00\x20abc")
    (tmp_path / "2024-01-03.b").write_bytes(d + b"\x00\x00" + d)
    (tmp_path / "2024-01-04.c").write_bytes(b"")
    (tmp_path / "2024-01-05.d").write_bytes(b"\x00\x02D!")
    got = feed.read_feed(spark, str(tmp_path))
    assert got.groupBy("file").count().agg(F.sum("count")).first()[0] == 4
    assert sorted(r.trailing for r in feed.trailing_bytes(spark, str(tmp_path)).collect()) == [0, 0, 5, 23]
    assert [r.ref for r in feed.messages(got).collect()] == [-1] * 3
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.gz").write_bytes(b"\x1f\x8b\x08")
    with pytest.raises(Exception, match="gzip-compressed"):
        feed.read_feed(spark, str(tmp_path / "z")).collect()


def test_bridge_through_files(spark, tmp_path):
    m = bridge.messages(spark, SF)
    feed.write_feed(feed.encoded(m), str(tmp_path / "f"))
    got = feed.messages(feed.read_feed(spark, str(tmp_path / "f")))
    cells = ["trade_date", "type", "locate", "ts_ns", "ref", "new_ref", "shares", "price"]
    keep = F.col("type").isin(*book.BOOK)
    want = m.filter(keep).withColumn("price", F.when(F.col("type").isin("A", "F", "U", "C"), F.col("price")))
    assert rows(got.filter(keep).select(cells)) == rows(want.select(cells))


def test_stream_equals_batch(spark, day, tmp_path):
    m = feed.messages(feed.read_feed(spark, day[0]))
    source = str(tmp_path / "in")
    m = m.withColumn("third", F.floor(F.col("ts_ns") / (8 * 3600 * 10**9)))
    for k in range(3):  # one file a batch, in order
        m.filter(F.col("third") == k).drop("third").coalesce(1).write.mode("append").parquet(source)
    locates = m.filter("type = 'R'").select("trade_date", "locate").distinct()
    stream = spark.readStream.schema(m.drop("third").schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = imbalance_stream(stream, locates).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("anomaly is not null").isEmpty()
    told = handoff(spark, query).filter("rows > 0").collect()
    assert len(told) == 3 and all(r["elapsed"] > 0 and not r["skewed"] for r in told)
    want = session.imbalance(session.top_changes(book.replay(m.drop("third"))), m)
    names = ["trade_date", "locate", "minute", "ofi", "events", "mid_open", "mid_close"]
    assert rows(got.select(names)) == rows(want.select(names))


def test_csv_order_of_a_minute_split_by_halts(spark, tmp_path):
    import datetime

    at, out = datetime.date(2024, 1, 2), [("S", 0, None, None, None, None, "Q"), ("A", 1, 1, 0, 100, 90_000, None), ("A", 1, 2, 1, 100, 91_000, None)]
    for k in range(60):  # each group adds k + 1 shares to the bid
        out += [("H", 1, None, None, None, None, "H"), ("H", 1, None, None, None, None, "T"), ("A", 1, 10 + k, 0, k + 1, 90_000, None)]
    cells = [(at, off, kind, locate, 36_000 * 10**9, ref, None, side, shares, price, None, code) for off, (kind, locate, ref, side, shares, price, code) in enumerate(out, 1)]
    m = spark.createDataFrame(cells, "trade_date date, off long, type string, locate int, ts_ns long, ref long, new_ref long, side int, shares long, price long, stock string, code string")
    found = session.named(session.imbalance(book.replay(m, changes=True), m), m)
    found = spark.createDataFrame(sorted(found.collect(), key=lambda r: -r["ofi"]), found.schema)
    feed.write_csv(found, str(tmp_path / "out"))
    lines = [line.split(",") for file in (tmp_path / "out").rglob("*.csv") for line in file.read_text().splitlines()[1:]]
    assert [line[:4] for line in lines] == [["locate 1", "10:00", str(k + 1), "1"] for k in range(60)]


def test_types_wide_and_tables(spark, day, tmp_path):
    """Only some types leave the reader; every field by name; unknown types keep their type; ranges shorter than a frame."""
    path, made = day
    all_rows = feed.read_feed(spark, path)
    some = feed.read_feed(spark, path, 50_000, types="AR")
    assert rows(some.select("off", "payload")) == rows(all_rows.filter("type in ('A', 'R')").select("off", "payload"))
    r = feed.table(all_rows, "R").first()
    assert (r["market_category"], r["round_lot_size"], r["issue_subtype"], r["etp_leverage_factor"], r["inverse_indicator"]) == ("Q", 100, "Z ", 0, "N")
    m = feed.wide(all_rows)
    want = feed.messages(all_rows).select("trade_date", "off", "type", "locate", "ts_ns", "shares")
    assert rows(m.select("trade_date", "off", "type", "locate", "ts_ns", F.col("shares").cast("long"))) == rows(want)
    frame = lambda load: len(load).to_bytes(2, "big") + load
    (tmp_path / "2024-01-02.x").write_bytes(frame(b"zodd") + frame(synthetic.pack("P", match=(1 << 64) - 1, tracking=65535, price=(1 << 32) - 1)) + frame(b"A\0"))
    got = feed.wide(feed.read_feed(spark, str(tmp_path))).orderBy("off").collect()
    assert [(r["type"], r["match"], r["tracking"], r["price"]) for r in got] == [("z", None, None, None), ("P", (1 << 64) - 1, 65535, (1 << 32) - 1)]
    one = tmp_path / "small"
    one.mkdir()
    (one / "2024-01-02.y").write_bytes(b"".join(frame(synthetic.pack("A", ref=k)) for k in range(50)))
    assert feed.read_feed(spark, str(one), 10).count() == 50


def test_relational_book_on_reused_references(spark):
    """The last depth of both books where references are used again after their orders died, and replaced by themselves."""
    import datetime
    import random

    from lobspark.operators.book import Book, depth_snapshot

    rng, model, out, live = random.Random(5), {1: Book(), 2: Book()}, [], {}
    for off in range(1, 1500):
        locate = rng.choice((1, 2))
        mine = [r for r, at in live.items() if at == locate]
        free = [r for r in range(40) if r not in live]
        kind = rng.choice("AAEXDU") if mine else "A"
        ref, shares, price, side = (rng.choice(mine) if kind != "A" else rng.choice(free)) if (mine or free) else 0, rng.randrange(1, 5) * 100, rng.randrange(95, 105), rng.randrange(2)
        new = None
        if kind == "A":
            live[ref] = locate
        elif kind == "U":
            new = rng.choice([*free, ref])
            del live[ref]
            live[new] = locate
        elif kind in "EX":
            shares = min(shares, model[locate].orders[ref][2])
        model[locate].apply(kind, ref, new or 0, side, shares, price)
        if kind in "DEX" and ref not in model[locate].orders:
            del live[ref]
        out.append((datetime.date(2024, 1, 2), off, kind, locate, ref, new, side if kind == "A" else None, None if kind == "D" else shares, price if kind in "AU" else None))
    messages = spark.createDataFrame(out, "trade_date date, off long, type string, locate int, ref long, new_ref long, side int, shares long, price long")
    got = {(r["locate"], r["side"], r["price"]): (r["qty"], r["orders"]) for r in depth_snapshot(messages).collect()}
    assert got == {(k, s, p): tuple(v) for k, b in model.items() for s in (0, 1) for p, v in b.levels[s].items()} and len(got) > 5
    roots = book.replace_roots(messages).collect()
    assert len(roots) == sum(k in "AU" for _, _, k, *_ in out) and max(r["hops"] for r in roots) > 3


def test_relational_top_on_many_levels(spark):
    """Every top of both books over hundreds of prices, replaces and sides that empty; no plan in which events meet levels by an inequality."""
    import datetime
    import random

    at, rng, model, out, live, want = datetime.date(2024, 1, 2), random.Random(7), {1: book.Book(), 2: book.Book()}, [], {}, {}
    for off in range(1, 2000):
        locate = rng.choice((1, 1, 1, 2))
        mine = [r for r, of in live.items() if of == locate]
        kind = rng.choice("AAAEXDUU" if off // 300 % 2 == 0 else "ADDDDEXU") if mine else "A"
        ref, new, side, shares, price = rng.choice(mine) if kind != "A" else 2 * off, 2 * off + 1, rng.randrange(2), rng.randrange(1, 5) * 100, rng.randrange(1, 3000)
        if kind in "EX":
            shares = min(shares, model[locate].orders[ref][2])
        assert model[locate].apply(kind, ref, new, side, shares, price) == ""
        live = {r: k for k, b in model.items() for r in b.orders}
        out.append((at, off, kind, locate, ref, new if kind == "U" else None, side if kind == "A" else None, None if kind == "D" else shares, price if kind in "AU" else None))
        want[off] = (locate, *model[locate].best(0), *model[locate].best(1))
    schema = "trade_date date, off long, type string, locate int, ref long, new_ref long, side int, shares long, price long"
    found = book.top_relational(spark.createDataFrame(out, schema))
    assert {r["off"]: (r["locate"], *(r[c] for c in book.TOP)) for r in found.collect()} == want
    assert len({r[8] for r in out if r[3] == 1}) > 512 and any(w[2] == 0 for w in want.values())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "<" in line]
    odd = [(at, 1, "A", 1, 1, None, 1, 100, None), (at, 2, "A", 1, 2, None, 1, 200, 50), (at, 3, "A", None, 3, None, 0, 100, 40)]  # a level without a price is none
    tops = {r["off"]: tuple(r[c] for c in book.TOP) for r in book.top_relational(spark.createDataFrame(odd, schema)).collect()}
    assert tops == {1: (0,) * 6, 2: (0, 0, 0, 50, 1, 200), 3: (0,) * 6}


def test_fold_on_odd_feeds(spark):
    """Every row of the fold, and its changes alone, against a book fed message by message: anomalies, days, null locates and fields."""
    import datetime
    import random

    rng, model, out, want, tops = random.Random(11), {}, [], [], {}
    for off in range(1, 3000):
        at, locate, kind = datetime.date(2024, 1, rng.choice((2, 3))), rng.choice((1, 2, 2, 9, None)), rng.choice("AAFECXDU")
        ref, new, side, shares, price = rng.randrange(40), rng.randrange(40), rng.randrange(2), rng.choice((None, 0, 1, 2, 3, 1 << 60)), rng.choice((None, 0, 95, 96, 97))
        b = model.setdefault((at, locate), book.Book())
        bad = locate in (None, 9) and kind in "AF" and shares
        odd = "bad_locate" if bad else b.apply(kind, ref, new, side, shares or 0, price or 0)
        out.append((at, off, kind, locate, off, ref, new, side, shares, price))
        levels = [{p: q for p, q in b.levels[s].items() if q[1]} for s in (0, 1)]
        best = [(max, min)[s](levels[s]) if levels[s] else None for s in (0, 1)]
        top = tuple(x for s in (0, 1) for x in ((best[s], levels[s][best[s]][1], levels[s][best[s]][0]) if levels[s] else (0, 0, 0)))
        want.append((at, locate, off, off, odd, len(b.orders), *top, top != tops.get((at, locate), (0,) * 6)))
        tops[at, locate] = top
    m = spark.createDataFrame(out, "trade_date date, off long, type string, locate int, ts_ns long, ref long, new_ref long, side int, shares long, price long")
    assert rows(book.replay(m, num_locates=9)) == sorted((w[:-1] for w in want), key=str)
    assert rows(book.replay(m, num_locates=9, changes=True)) == sorted((w[:-1] for w in want if w[-1]), key=str)
    assert len({w[4] for w in want}) == 6
