"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersections of sorted arrays.

A document's set holds its distinct k-word shingles as sorted 64-bit hashes; equal sets are one set from the
start. Sets fall into bands of sizes that may link (a band and the next smaller one). Within a band two linked
sets differ in at most H shingles, so of more than H parts of the hash space at least one holds the very same
shingles in both: the part's digest is a key, and sets that share a key form a tile. Parts are chosen so that
also one part that isn't empty agrees; the few sets with more empty parts than reckoned give keys for those too.

In a tile, bit counts of hashed bitmaps bound every pair's overlap from above (two sets differ in at least as
many shingles as their bitmaps in bits); pairs that pass are intersected exactly. To keep work linear for large
groups of near copies, every set is first compared with the smallest set of all its tiles, in blocks; only tiles that
still hold several components go on to all pairs of blocks, across components only, by bitmaps and then, within
what bitmaps leave connected, by exact intersection. What is left out is in one component already, so
components are exact: no pair that could add a link is skipped.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A text with fewer than k words is one shingle;
texts without words, null included, are empty sets and link with nothing. Rows with a null identifier get a null
component and take no part. Rows that repeat an identifier share its component. Other columns are ignored; an
empty table gives an empty result. Only counts of rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .store import drop, partitions, written
from .textnum import HASHED, U, mix, pieces, shingle_sets, utf8

TILE = 1024  # sets in a tile at most; larger tiles are split into blocks
MANY = np.uint64(1) << np.uint64(63)


@cache
def bands(percent: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each size band: its largest size, its number of parts (0: only equal sets link), and the empty parts reckoned with."""
    high, parts, spare = [], [], []
    low = before = 1
    while low < top:
        up = max(low, low * 100 // percent)
        h = 2 * up * (100 - percent) // (100 + percent)
        k, e = h + 1, 0
        for _ in range(20):
            mean = k * np.exp(-before / k)
            e = int(np.ceil(mean + 4 * np.sqrt(mean)))
            if h + 1 + e <= k:
                break
            k = h + 1 + e
        high.append(up)
        parts.append(k if h else 0)
        spare.append(k - h - 1 if h else 0)
        before, low = low, up + 1
    return np.array(high), np.array(parts), np.array(spare)


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each sorted set; 0 for empty ones."""
    total = np.concatenate([[U(0)], np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)), dtype=U)])
    n = np.diff(bounds)
    out = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U) * U(0x2545F4914F6CDD1D))
    out[n == 0] = 0
    return out


def tile_keys(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every part of every row's set, in its own band and the next."""
    high, parts, spare = bands(percent)
    n = np.diff(bounds)
    own = np.searchsorted(high, n)
    rows, keys = [], []
    owner = np.repeat(np.arange(len(n)), n)
    content = mix(values ^ U(0x9FB21C651E98DF25))
    for up in (0, 1):
        band = own + up
        k = parts[band]
        use = (n > 0) & (k > 0)
        if up:
            use &= n * 100 >= (high[own] + 1) * percent  # some larger size of the next band may link
        mine = use[owner]
        v, o, c = values[mine], owner[mine], content[mine]
        if not len(v):
            continue
        part = ((v >> U(32)) * k[o].astype(U)) >> U(32)
        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(first, len(v))).astype(U)
        r, p = o[first], part[first]
        seed = band[r].astype(U) * U(0xD6E8FEB86659FD93) + p * U(0xA0761D6478BD642F)
        rows.append(r)
        keys.append(mix(np.add.reduceat(c, first) + mix(seed + size * U(0xE7037ED1A0B428DB))))
        filled = np.bincount(r, minlength=len(n))
        for i in np.flatnonzero(use & (k - filled > spare[band])).tolist():
            empty = np.setdiff1d(np.arange(k[i], dtype=U), p[r == i])
            rows.append(np.full(len(empty), i))
            keys.append(mix(mix(U(int(band[i]) * 0xD6E8FEB86659FD93 % (1 << 64)) + empty * U(0xA0761D6478BD642F))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows), np.concatenate(keys)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set: a power of two of bits, at least two for each shingle and 64."""
    bits = 64 << max(0, int(2 * len(values) - 1).bit_length() - 6)
    out = np.zeros(bits, np.uint8)
    out[(values & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(U)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps at the shortest one's length: halves are or-ed, which keeps the bound true."""
    size = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, size), axis=0) for m in maps])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(kind: str, percent: int, side: np.ndarray, n: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Component of every set of one tile: sets given as bitmaps ("bits") or as sorted arrays ("sets").

    side 0 is compared with side 1 only; side 2 with all of side 2. Sets of one component aren't compared.
    """
    maps = folded(sets if kind == "bits" else [bitmap(s) for s in sets])
    _, label = np.unique(comp, return_inverse=True)
    first = {}
    for i, c in enumerate(label.tolist()):
        first.setdefault(c, i)
    root = np.array([first[c] for c in label.tolist()])
    for i in range(len(n) - 1):
        if side[i] == 1:
            continue
        rest = np.arange(i + 1, len(n))
        rest = rest[(root[rest] != root[i]) & ((side[rest] == 1) if side[i] == 0 else True)]
        if not len(rest):
            continue
        least = np.bitwise_count(maps[rest] ^ maps[i]).sum(1, dtype=np.int64)
        most = np.minimum((n[rest] + n[i] - least) // 2, np.minimum(n[rest], n[i]))
        rest = rest[100 * most >= percent * (n[rest] + n[i] - most)]
        if kind == "bits":
            root[np.isin(root, root[rest])] = root[i]
            continue
        for j in rest.tolist():
            if root[j] == root[i]:
                continue
            o = overlap(sets[i], sets[j])
            if 100 * o >= percent * (n[i] + n[j] - o):
                root[root == root[j]] = root[i]
    return root


def tile_links(rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links a, b (a spanning forest of each tile's links) of rows tile, side, sid, comp, n, s (bytes of the set or bitmap)."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        if t.num_rows < 2:
            return None
        order = np.argsort(t.column(1).to_numpy(), kind="stable")
        side, sid, comp, n = (t.column(k).to_numpy()[order] for k in (1, 2, 3, 4))
        flat = t.column(5).combine_chunks()
        sets = [np.frombuffer(flat[i].as_buffer(), U) for i in order.tolist()]
        root = links(kind, percent, side, n, comp, sets)
        moved = comp != comp[root]
        a, b = comp[moved], comp[root[moved]]
        if not len(a):
            return None
        both = np.unique(np.stack([a, b], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for x, y in zip(cuts, cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != int(tile[x]):
                    if (out := done(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(x, y - x))
        if held and (out := done(held)) is not None:
            yield out

    rows = rows.select("tile", F.col("side").cast("int"), "sid", "comp", "n", "s")
    return rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def blocks(rows: DataFrame, by: str, size: DataFrame) -> DataFrame:
    """Tiles of rows (by, sid, ...): all pairs of blocks of one `by`. size: by, weight (in blocks)."""
    split = rows.join(size, by).withColumn("k", F.greatest(F.lit(1), F.ceil("weight")).cast("long"))
    b = F.pmod(F.xxhash64("sid"), F.col("k"))
    split = split.withColumn("b", b).withColumn("o", F.explode(F.expr("sequence(0L, k - 1)")))
    tile = F.xxhash64(F.col(by), F.least("b", "o"), F.greatest("b", "o"))
    return split.withColumn("tile", tile).withColumn("side", F.when(F.col("k") == 1, 2).when(F.col("b") < F.col("o"), 0).when(F.col("b") > F.col("o"), 1).otherwise(2)).drop("k", "b", "o", "weight")


def _classed(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """i, sid (the set; 0: empty), n, class (one of the component's sets) and least (its smallest identifier) of every row."""
    spark = docs.sparkSession
    p = partitions(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))

    def sets_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for part in pieces(batch, 1, HASHED):
            values, bounds = shingle_sets(*utf8(part.column(1)), k)
            yield part, values, bounds, set_ids(values, bounds)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, bounds, sid in sets_of(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sid.view(np.int64)), pa.array(np.diff(bounds))], ["i", "sid", "n"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task give their keys once
        for batch in batches:
            for part, values, bounds, sid in sets_of(batch):
                new = np.zeros(len(sid), bool)
                valid = np.ones(len(sid), bool) if not part.column(0).null_count else part.column(0).is_valid().to_numpy(zero_copy_only=False)
                for r, s in enumerate(sid.tolist()):
                    if s and valid[r] and s not in seen:
                        seen.add(s)
                        new[r] = True
                row, key = tile_keys(values, bounds, percent)
                keep = new[row]
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(sid[row[keep]].view(np.int64))], ["key", "sid"])

    members = written(plain.mapInArrow(identify, "i long, sid long, n long"), "sets")
    keys = plain.mapInArrow(keyed, "key long, sid long").repartition(p, "key").sortWithinPartitions("key", "sid")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of keys with several sets: tile, sid, first (the key's smallest set). Keys with the same few sets give one tile."""
        key, sid, begun, told = np.zeros(0, np.int64), np.zeros(0, np.int64), None, set()

        def out(key: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
            key, sid = key[new], sid[new]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(at, len(key)))
            some = count > 1
            sums = np.add.reduceat(mix(sid.view(U)), at)
            tile = np.where(count <= TILE, (mix(sums + count.astype(U)) | MANY).view(np.int64), (key[at].view(U) & ~MANY).view(np.int64))
            if len(told) > 200_000:
                told.clear()
            for j in np.flatnonzero(some).tolist():
                if count[j] <= TILE:
                    some[j] = int(tile[j]) not in told
                    told.add(int(tile[j]))
            rows = np.repeat(some, count)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(tile, count)[rows]), pa.array(sid[rows]), pa.array(np.repeat(sid[at], count)[rows])], ["tile", "sid", "first"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            sid = np.concatenate([sid, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if cut:
                if begun is not None and key[0] == begun[0]:
                    end = int(np.searchsorted(key, key[0], "right"))
                    yield big(key[:end], sid[:end], begun[1])
                    if end < cut:
                        yield out(key[end:cut], sid[end:cut])
                else:
                    yield out(key[:cut], sid[:cut])
                key, sid, begun = key[cut:], sid[cut:], None
            if len(key) > 4 * TILE:  # one key with many sets: passed on as it comes
                distinct = np.unique(sid)
                if len(distinct) > TILE:
                    if begun is None:
                        begun = (key[0], distinct[0])
                    last = distinct[-1]
                    yield big(np.full(len(distinct) - 1, key[0]), distinct[:-1], begun[1])
                    key, sid = key[:1], np.array([last])
                else:
                    key, sid = np.full(len(distinct), key[0]), distinct
        if len(key):
            yield big(key, np.unique(sid), begun[1]) if begun is not None else out(key, sid)

    def big(key: np.ndarray, sid: np.ndarray, first: int) -> pa.RecordBatch:
        sid = np.unique(sid)
        tile = np.full(len(sid), (key[:1].view(U) & ~MANY).view(np.int64)[0])
        return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(sid), pa.array(np.full(len(sid), first))], ["tile", "sid", "first"])

    tiles = written(keys.mapInArrow(runs, "tile long, sid long, first long").distinct(), "tiles")

    # sorted arrays and bitmaps of the sets that are in some tile
    wanted = tiles.select("sid").distinct()
    firsts = written(members.filter("sid <> 0 and i is not null").groupBy("sid").agg(F.min("i").alias("i")), "firsts")
    reps = firsts.join(wanted, "sid")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = pa.Table.from_batches([batch])
            at = 0
            for part, values, bounds, sid in sets_of(batch):
                want = expected.column(2).slice(at, part.num_rows).to_numpy()
                at += part.num_rows
                rows = np.flatnonzero(sid.view(np.int64) == want).tolist()  # rows that repeat an identifier may hold another text
                arr = [values[bounds[r] : bounds[r + 1]] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(want[rows]), pa.array([len(a) for a in arr], pa.int64()), pa.array([a.tobytes() for a in arr], pa.binary()), pa.array([bitmap(a).tobytes() for a in arr], pa.binary())], ["sid", "n", "arr", "bits"])

    held = written(plain.join(reps, "i").select("i", "t", "sid").mapInArrow(arrays, "sid long, n long, arr binary, bits binary"), "arrays")

    # each set with the smallest first set of its tiles, in blocks; one comparison a set, so arrays move once
    stars = tiles.filter("sid <> first").groupBy("sid").agg(F.min("first").alias("first"))
    heavy = stars.join(held.select("sid", "n"), "sid").groupBy("first").agg(F.greatest(F.count("*") / 512, F.sum("n") / (1 << 19)).alias("weight"))
    heavy = written(heavy.withColumn("k", F.greatest(F.lit(1), F.ceil("weight")).cast("long")).select("first", "k"), "stars")
    # tiles are found from identifiers alone, so that arrays are shuffled only to their sets and then to their tiles
    spokes = stars.join(heavy, "first").select(F.xxhash64("first", F.pmod(F.xxhash64("sid"), F.col("k"))).alias("tile"), F.lit(1).alias("side"), "sid", F.col("sid").alias("comp"))
    centres = heavy.withColumn("b", F.explode(F.expr("sequence(0L, k - 1)"))).select(F.xxhash64("first", "b").alias("tile"), F.lit(0).alias("side"), F.col("first").alias("sid"), F.col("first").alias("comp"))
    star = spokes.unionByName(centres).join(held.select("sid", "n", F.col("arr").alias("s")), "sid")
    sure = written(tile_links(star, "sets", percent), "links")
    group = components(sure)

    # tiles that still hold several components: bitmaps, then exact
    mine = tiles.select("tile", "sid").distinct().join(group.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    mine = written(mine, "open")
    several = mine.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
    size = written(several.select("tile", (F.col("c") / TILE).alias("weight")), "several")
    loose = mine.withColumnRenamed("tile", "t")
    tiled = blocks(loose, "t", size.withColumnRenamed("tile", "t")).join(held.select("sid", "n", F.col("bits").alias("s")), "sid")
    maybe = written(tile_links(tiled, "bits", percent), "maybe")
    cluster = components(maybe)
    in_one = mine.select("sid", "comp").distinct().join(cluster.withColumnRenamed("node", "comp"), "comp").join(held.select("sid", "n"), "sid")
    weight = in_one.groupBy("component").agg(F.greatest(F.count("*") / 512, F.sum("n") / (1 << 19)).alias("weight"))
    exact = blocks(in_one.select("component", "sid", "comp"), "component", weight).join(held.select("sid", "n", F.col("arr").alias("s")), "sid")
    more = written(tile_links(exact, "sets", percent), "links2")
    for used in (held, tiles, mine):
        drop(used)
    joined = components(sure.unionByName(more)) if not more.isEmpty() else group

    # smallest identifier of every set, then of every component: hot sets and components are aggregated before they are joined
    sets = firsts.join(joined.withColumnRenamed("node", "sid"), "sid", "left")
    least = written(sets.filter("component is not null").groupBy("component").agg(F.min("i").alias("least")), "least")
    sets = sets.join(least, "component", "left").select("sid", F.coalesce("component", "sid").alias("class"), F.coalesce("least", "i").alias("least"))
    return members.join(sets, "sid", "left")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row; sets link when 100 * intersection >= percent * union."""
    out = _classed(docs, k, percent, id_col, text_col)
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("i").isNotNull(), F.coalesce("least", "i")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component one, with the smallest identifier; rows without words or identifier all stay."""
    rows = written(_classed(docs, k, percent, id_col, text_col).filter("i is not null").select("i", "sid", "class", "least"), "classed")
    # an identifier of one row is decided by itself; rows that share one are told apart by their sets
    several = written(rows.groupBy("i").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("i").alias("__i")), "several")
    lost = rows.filter("class is not null and i <> least").select(F.col("i").alias("__i")).distinct().join(several, "__i", "left_anti")
    mine = F.col(id_col).cast("long") == F.col("__i")
    if several.isEmpty():
        return docs.join(lost, mine, "left_anti")
    alone = docs.join(lost.unionByName(several), mine, "left_anti")
    at, names = docs.columns.index(text_col), docs.columns

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at, HASHED):
                values, bounds = shingle_sets(*utf8(part.column(at)), k)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(set_ids(values, bounds).view(np.int64))], [*(f"own_{j}" for j in range(len(names))), "sid"])

    wanted = docs.join(several, mine, "left_semi")
    kind = T.StructType([*(T.StructField(f"own_{j}", f.dataType) for j, f in enumerate(wanted.schema)), T.StructField("sid", T.LongType())])
    wanted = wanted.mapInArrow(marked, kind)
    own = F.col(f"own_{names.index(id_col)}").cast("long")
    best = rows.filter("class is not null and i = least").join(several, F.col("i") == F.col("__i"), "left_semi").groupBy("i", "class").agg(F.min("sid").alias("best")).select("i", "best")
    whole = F.struct(*(f"own_{j}" for j in range(len(names)))).alias("row")
    first = wanted.join(best, (own == F.col("i")) & (F.col("sid") == F.col("best"))).groupBy("i", "sid").agg(F.first(whole).alias("row"))
    kept = first.select("row").unionByName(wanted.filter("sid = 0").select(whole))
    return alone.unionByName(kept.select(*(F.col(f"row.own_{j}").alias(c) for j, c in enumerate(names))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, with its columns; rows without identifier stay."""
    return one_of_each(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k : k + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
