"""Embedding near-duplicates: int8 tile products with per-vector error bounds.

Equal vectors are first made one, with their count. A unit vector u is held as scale * q + r with int8 q, and
e = |r| is its quantisation error, so u.v lies within e_u + e_v (1 + e_u) of s_u s_v q_u.q_v. Codes, scales and errors
are made once. Blocks of the distinct vectors meet in tiles, every pair of blocks once, as int8 codes: a tile tells
which of its vectors have a pair that may reach the threshold. Only these are fetched in double precision, to that
tile; there pairs whose bounds lie on one side of the threshold are settled by them, and all others are computed
in double precision. The int8 products are summed exactly: in single precision over DIMS dimensions at a time (below
2**24), then in double. A tile returns a row for each vector that has links, not a row for each link: how many
vectors it is linked with there, and its group in the tile.

Vectors that are null, zero, or hold null or non-finite components, and vectors of another length, link with
nothing. Rows that repeat an identifier are rows of their own. Other columns are ignored; an empty table gives
an empty result. The number of tiles grows with the square of the distinct vectors over the block size, and every
code goes to as many tiles as there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, contract
from .store import partitions, written

SUB = 512  # rows of a tile multiplied at once
DIMS = 1024  # 127 * 127 * DIMS < 2**24
BLOCK_VALUES = 1 << 19  # components of a block's vectors, about
SLACK = 1e-6  # above every rounding error of scaling and comparing


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (double), int8 codes, scales and errors of the rows of x."""
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components don't overflow or vanish
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * q) ** 2).sum(1)) * (1 + 1e-9)
    return unit, q, scale, error


def products(q: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes; right: transposed, in single precision."""
    out = q[:, :DIMS].astype(np.float32) @ right[:DIMS]
    if q.shape[1] > DIMS:
        out = out.astype(np.float64)
        for k in range(DIMS, q.shape[1], DIMS):
            out += q[:, k : k + DIMS].astype(np.float32) @ right[k : k + DIMS]
    return out


def bounds(x: tuple, y: tuple, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, estimate, error) of the cosines of some rows of x with all of y; x, y: codes, scales, errors. same: the diagonal gets -2."""
    (qx, sx, ex), (qy, sy, ey) = x, y
    right = np.ascontiguousarray(qy.astype(np.float32).T)
    for at in range(0, len(qx), SUB):
        part = slice(at, at + SUB)
        about = products(qx[part], right) * (sx[part, None] * sy[None, :])
        if same:
            about[np.arange(len(about)), at + np.arange(len(about))] = -2
        yield at, about, ex[part, None] + ey[None, :] * (1 + ex[part, None]) + SLACK


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the links between rows of x and rows of y, in pieces; y None: within x, both directions."""
    ux, *cx = quantise(x)
    uy, *cy = (ux, *cx) if y is None else quantise(y)
    for at, about, error in bounds(cx, cy, y is None):
        sure = about - error >= threshold
        r, c = np.nonzero((about + error >= threshold) & ~sure)
        for k in range(0, len(r), 65536):
            i, j = r[k : k + 65536], c[k : k + 65536]
            sure[i, j] = (ux[at + i] * uy[j]).sum(1) >= threshold
        r, c = np.nonzero(sure)
        yield at + r, c


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table a tile; rows are sorted by tile, so one is complete when the next begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tile = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for x, y in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != int(tile[x]):
                yield pa.Table.from_batches(held)
                held = []
            if x < y:
                held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def matrix(lists: pa.ListArray, rows: np.ndarray, d: int) -> np.ndarray:
    """The lists of some rows, all of length d."""
    start, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return flat[(start[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)


def embedding_links(vectors: DataFrame, threshold: float = 0.9, block: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("i").isNotNull()
    usable = rows.filter(good)
    distinct = written(usable.groupBy("v").agg(F.min("i").alias("rep"), F.count("*").alias("c")), "distinct")
    total, width = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    block = block or max(256, min(4096, BLOCK_VALUES // (width or 1)))
    blocks = max(1, -(-total // block))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                _, q, scale, error = quantise(matrix(lists, mine, d))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(d)), len(mine), [None, pa.py_buffer(np.ascontiguousarray(q))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine)), raw, pa.array(scale), pa.array(error)], ["rep", "q", "s", "e"])

    codes = written(distinct.select("rep", "v").mapInArrow(coded, "rep long, q binary, s double, e double"), "codes")
    b = F.pmod(F.xxhash64("rep"), F.lit(blocks))
    tiles = codes.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = tiles.select((F.least("b", "o") * blocks + F.greatest("b", "o")).cast("long").alias("tile"), (F.col("b") > F.col("o")).cast("int").alias("side"), "rep", "q", "s", "e")

    def sides(width: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """Of each length of vectors, it and the rows that meet; None: the same rows."""
        for d in np.unique(width):
            mine = np.flatnonzero(width == d)
            a, z = mine[side[mine] == 0], mine[side[mine] == 1]
            if len(z) and len(a):
                yield int(d), a, z
            elif not side.any() and len(a) > 1:
                yield int(d), a, None

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_tile(batches):
            side, rep, scale, error = (part.column(k).to_numpy() for k in (1, 2, 4, 5))
            raw = part.column(3).combine_chunks()
            if isinstance(raw, pa.ChunkedArray):
                raw = pa.concat_arrays(raw.chunks)
            start, flat = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64), np.frombuffer(raw.buffers()[2], np.int8)
            maybe = np.zeros(len(rep), bool)
            for d, one, two in sides(np.diff(start), side):
                q = [flat[(start[r][:, None] + np.arange(d)).ravel()].reshape(-1, d) for r in ((one,) if two is None else (one, two))]
                y = one if two is None else two
                for at, about, wide in bounds((q[0], scale[one], error[one]), (q[-1], scale[y], error[y]), two is None):
                    may = about + wide >= threshold
                    maybe[one[at : at + SUB][may.any(1)]] = True
                    maybe[y[may.any(0)]] = True
            hit = pa.array(np.flatnonzero(maybe))
            yield pa.RecordBatch.from_arrays([part.column(k).take(hit).combine_chunks() for k in (0, 1, 2)], ["tile", "side", "rep"])

    def done(part: pa.Table) -> pa.RecordBatch:
        side, rep, c = (part.column(k).to_numpy() for k in (1, 2, 3))
        lists = part.column(4).combine_chunks()
        width = np.diff(lists.offsets.to_numpy())
        n, left, right = np.zeros(len(rep), np.int64), [], []
        for d, one, two in sides(width, side):
            for r, k in tile_links(matrix(lists, one, d), None if two is None else matrix(lists, two, d), threshold):
                r, k = one[r], (one if two is None else two)[k]
                n += np.bincount(r, c[k], len(n)).astype(np.int64)
                if two is not None:
                    n += np.bincount(k, c[r], len(n)).astype(np.int64)
                label = contract(r, k, len(n))
                moved = np.flatnonzero(label != np.arange(len(n)))
                left.append(moved)
                right.append(label[moved])
        label = contract(np.concatenate(left), np.concatenate(right), len(n)) if left else np.arange(len(n))
        hit = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(n[hit]), pa.array(rep[label[hit]])], ["rep", "n", "root"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_tile(batches):
            yield done(part)

    count = blocks * (blocks + 1) // 2
    dealt = tiles.repartition(max(partitions(spark), min(count, 4 * partitions(spark))), "tile").sortWithinPartitions("tile")
    some = written(dealt.mapInArrow(screen, "tile long, side int, rep long"), "screened")
    fetched = some.join(distinct, "rep").select("tile", "side", "rep", "c", "v").repartition(max(partitions(spark), min(count, 4 * partitions(spark))), "tile").sortWithinPartitions("tile")
    links = written(fetched.mapInArrow(verify, "rep long, n long, root long"), "tiles")
    group = components(links.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("rep").agg(F.sum("n").alias("n"))
    info = distinct.join(degree, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("v", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = usable.join(info, "v").select("i", "n", "component").unionByName(rows.filter(~good).select("i", F.lit(0).cast("long").alias("n"), F.col("i").alias("component")))
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("i").eqNullSafe(F.col("component")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.u) = len(b.u) WHERE list_inner_product(a.u, b.u) >= 0.9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, min(other) = vec_id AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""
