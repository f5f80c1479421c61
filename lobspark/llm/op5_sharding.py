"""Balanced label propagation under the `rows` law: shards' row counts differ by at most one.

Documents with equal texts are linked. A document starts in the shard of its identifier's hash, and votes for it. In
every round each group that isn't settled wants the shard most of its documents voted for among those with room (one
by hash if none of them has), and goes there as a whole if its turn comes: a hash of group and round against the
shard's room over the rows that want it. Room is a shard's quota less the rows of settled groups, as single documents
give way at the end. A group of more rows than a quota is first dealt into parts of about half a quota. Groups of more
than a 1/BIG of a quota (at most BIG * shards, and parts) are settled one after another on the driver, largest first.
At the end every shard's documents are numbered, those of groups first, and those beyond the shard's exact size fill
the free slots of other shards in order. Groups that found no room in all rounds stay where their documents started;
no other group that fits a shard is split.

Null text counts as empty with size 1 and crc32 0, and empty texts are one group like any other. Null identifiers
hash like a value. Rows that repeat an identifier are rows of their own. Other columns are ignored; an empty table
gives an empty result. Rounds work on a row for each group, not for each document. Only shard-by-shard counts and
the BIG * shards largest groups reach the driver or are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import drop, partitions, written

BIG = 64


def _settled_big(big: list, room: list[int]) -> list[tuple[int, int, int]]:
    """(g, sub, shard) of the largest groups: the first shard voted for that has room, else the one with most room."""
    out = []
    for r in sorted(big, key=lambda r: (-r["gn"], r["g"], r["sub"])):
        to = next((v["shard"] for v in r["votes"] if room[v["shard"]] >= r["gn"]), None)
        if to is None:
            to = max(range(len(room)), key=lambda s: (room[s], -s))
        room[to] -= r["gn"]
        out.append((r["g"], r["sub"], to))
    return out


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null under this law), group_size."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text, F.md5(text)).alias("g"))
    rows = written(rows.withColumn("start", F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int")).withColumn("r", F.monotonically_increasing_id()), "members")
    total = rows.count()
    quota = total // shards
    # a group larger than a quota, at most one a shard, is dealt into parts
    sizes = written(rows.groupBy("g").agg(F.count("*").alias("gn")).filter("gn > 1"), "groups")
    giant = {r["g"]: -(-2 * r["gn"] // max(1, quota)) for r in sizes.filter(F.col("gn") > max(1, quota)).collect()}
    parts = F.create_map(*[x for g, c in giant.items() for x in (F.lit(g), F.lit(c))])[F.col("g")] if giant else F.lit(None)
    rows = rows.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("r"), parts), F.lit(0)).cast("int") if giant else F.lit(0))
    tie = F.xxhash64("g", "start")  # ties must not all favour one shard
    votes = rows.groupBy("g", "sub", "start").agg(F.count("*").alias("n")).groupBy("g", "sub").agg(F.sum("n").alias("gn"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), tie.alias("tie"), F.col("start").alias("shard")))).alias("votes"))
    votes = written(votes.filter("gn > 1"), "votes")
    large = max(1, quota // BIG)
    room = [quota] * shards
    big = _settled_big(votes.filter(F.col("gn") > large).collect(), room)
    state, settled, rounds_made = votes.filter(F.col("gn") <= large), [], []
    for step in range(rounds):
        free = [s for s in range(shards) if room[s] > 0] or list(range(shards))
        voted = F.filter("votes", lambda v: v["shard"].isin(free))
        one = F.element_at(F.array(*map(F.lit, free)), F.pmod(F.xxhash64("g", "sub", F.lit(step)), F.lit(len(free))).cast("int") + 1)
        wish = state.withColumn("want", F.coalesce(F.get(voted, F.lit(0))["shard"], one).cast("int"))
        asked = {r["want"]: r["n"] for r in wish.groupBy("want").agg(F.sum("gn").alias("n")).collect()}
        if not asked:
            break
        share = F.create_map(*[x for s, n in asked.items() for x in (F.lit(s), F.lit(1.0 if n <= room[s] else max(0.0, 0.95 * room[s] / n)))])
        goes = F.pmod(F.xxhash64("g", "sub", F.lit(100 + step)), F.lit(1 << 20)) < share[F.col("want")] * (1 << 20)
        moved = written(wish.withColumn("goes", goes), f"round{step}")
        rounds_made.append(moved)
        settled.append(moved.filter("goes").select("g", "sub", "want"))
        state = moved.filter("not goes").select(*votes.columns)
        for r in settled[-1].join(votes, ["g", "sub"]).groupBy("want").agg(F.sum("gn").alias("n")).collect():
            room[r["want"]] -= r["n"]
    moved = spark.createDataFrame(big, "g long, sub int, want int")
    small = None
    for s in settled:
        small = s if small is None else small.unionByName(s)
    large_rows = rows.join(F.broadcast(moved), ["g", "sub"])  # at most BIG * shards groups, and parts
    others = rows.join(F.broadcast(moved.select("g", "sub")), ["g", "sub"], "left_anti")
    others = others.join(small, ["g", "sub"], "left") if small is not None else others.withColumn("want", F.lit(None).cast("int"))
    placed = large_rows.unionByName(others).withColumn("shard", F.coalesce("want", "start")).withColumn("o", F.col("want").isNull().cast("int"))
    placed = placed.join(sizes, "g", "left").withColumn("gn", F.coalesce("gn", F.lit(1).cast("long")))
    buckets = max(4, min(4096, partitions(spark)))
    every = written(placed.withColumn("k", F.pmod(F.xxhash64("r", F.lit(7)), F.lit(buckets)).cast("int")).select("i", "r", "size", "crc", "gn", "shard", "o", "k"), "placed")
    # two-pass numbering: counts of (shard, in a group or not, bucket), then ranks inside
    cells = every.groupBy("shard", "o", "k").agg(F.count("*").alias("n"))
    cells = cells.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("o", "k").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    ranked = every.withColumn("at", F.row_number().over(W.partitionBy("shard", "o", "k").orderBy("r")))
    ranked = ranked.join(cells.drop("n"), ["shard", "o", "k"]).withColumn("slot", F.col("base") + F.col("at") - 1)
    have = [held.get(s, 0) for s in range(shards)]
    exact = [quota] * shards
    for s in sorted(range(shards), key=lambda s: -have[s])[: total % shards]:
        exact[s] += 1
    over, free, at = [], [], 0
    for s in range(shards):
        over.append((s, at - exact[s], exact[s]))  # a surplus row's number is its slot plus this
        at += max(0, have[s] - exact[s])
    at = 0
    for s in range(shards):
        gap = max(0, exact[s] - have[s])
        if gap:
            free.append((s, at, at + gap, have[s] - at))
        at += gap
    size_of = F.create_map(*[x for s, _, m in over for x in (F.lit(s), F.lit(m).cast("long"))])
    shift = F.create_map(*[x for s, d, _ in over for x in (F.lit(s), F.lit(d).cast("long"))])
    number = F.col("slot") + shift[F.col("shard")]
    to, slot = F.col("shard"), F.col("slot")
    for s, a, b, d in free:
        here = (F.col("slot") >= size_of[F.col("shard")]) & (number >= a) & (number < b)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, number + d).otherwise(slot)
    for used in (rows, sizes, votes, *rounds_made):
        drop(used)
    return ranked.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("gn").alias("group_size"))


def cut_edges(placed: DataFrame, group: str = "text_crc32") -> DataFrame:
    """groups, split (groups in several shards) and cut (pairs of rows of a group in different shards) of a result; `group`: what tells its groups apart."""
    cells = placed.groupBy(group, "size", "shard").agg(F.count("*").alias("n"))
    of = cells.groupBy(group, "size").agg(F.sum("n").alias("n"), F.count("*").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).filter("n > 1")
    return of.agg(F.count("*").alias("groups"), F.count_if(F.col("s") > 1).alias("split"), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.lit(0)).cast("long").alias("cut"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)


ORACLE = None
