"""Substring deduplication by repeated-phrase automata.

A window is `window` consecutive words of one document; a word goes when a window that covers it also starts in a
document with a smaller identifier. Every window's smallest phrase (of PHRASE words, by hash) is its anchor, so
equal windows have equal anchors, and only about one phrase in twenty is one.

1. Anchors are counted over all documents, per shard of documents; those that two documents hold recur.
2. Every shard gets its documents and the recurring anchors that stand in it. It compiles one Aho-Corasick automaton
   of these phrases (each word as two of 128 symbols) and streams all its documents through it; every hit is confirmed
   by comparing its words with the phrase's. Windows with such an occurrence are candidates, keyed by their smallest
   phrase and their own hash. Within the shard the smallest document of a window settles the others at once.
3. What is left meets by anchor and group of shards, then by anchor, each time at most one document of a part for each
   window, and is settled in order of documents. No pairs are made. An anchor that many different windows have, as a
   line common to many documents, is split by the windows' own hashes; equal windows of all shards meet in about the
   square root of the shards' number of rows.
4. Documents with candidates get their settled windows back and lose the words.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged; kept words are joined by one space. Null text has none. Windows are
judged on the input. A null identifier counts as smaller than any other; rows that repeat an identifier don't
affect each other. Other columns are ignored; an empty table gives an empty result. Windows of one shard and of
several are told apart by two 64-bit hashes over their words' 64-bit hashes (their anchor's and their own). A shard
holds about `shard_bytes` of text, which bounds its automaton; a task works on one shard after another, at most TASKS.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import drop, partitions, written
from .textnum import HASHED, SPACES, U, pieces, ragged, run_hashes, utf8, word_bounds, word_hashes

PHRASE = 12
HOT = 2000  # windows of an anchor beyond which they are dealt out by their own hashes too
TASKS = 20_000  # partitions that shards are dealt to, at most
FAR = ~U(0)
NONE = -(1 << 63)


def sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """`of` over every `width` consecutive values."""
    if len(x) < width:
        return x[:0]
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = of(x[:-step], x[step:])
        step *= 2
    return of(x[:n], x[width - step : width - step + n])


class Text:
    """Words of a slice of rows: bounds, hashes, rows, phrase hashes (FAR where a phrase would cross rows)."""

    def __init__(self, column: pa.Array, window: int) -> None:
        self.data, off = utf8(column)
        starts, ends, row = word_bounds(self.data, off, SPACES)
        self.h = word_hashes(self.data, starts, ends)
        self.starts, self.ends, self.row = starts.astype(np.int32), ends.astype(np.int32), row.astype(np.int32)
        self.count = np.bincount(self.row, minlength=len(column))
        self.first = np.cumsum(self.count) - self.count
        self.window = window
        g = run_hashes(self.h, PHRASE)
        self.phrase = np.where(self.row[: len(g)] == self.row[PHRASE - 1 :], np.minimum(g, FAR - U(1)), FAR) if len(g) else g
        n = max(0, len(self.h) - window + 1)
        self.whole = self.row[:n] == self.row[window - 1 :] if n else np.zeros(0, bool)

    def symbols(self, at: slice = slice(None)) -> str:
        """Two characters a word: 7 bits of its hash each, the second from another range."""
        h = self.h[at]
        out = np.empty((len(h), 2), np.uint32)
        out[:, 0], out[:, 1] = (h >> U(32)) & U(127), (h >> U(39)) & U(127) | U(128)
        return out.tobytes().decode("utf-32-le")

    def words(self, at: int) -> bytes:
        """The words of the phrase at a position, as they stand."""
        return self.data[self.starts[at] : self.ends[at + PHRASE - 1]].tobytes()

    def anchors(self) -> np.ndarray:
        """Positions of phrases that are the smallest of some window."""
        reach = self.window - PHRASE + 1
        if not self.whole.any():
            return np.zeros(0, np.int64)
        least = np.where(self.whole, sliding(self.phrase, reach, np.minimum), U(0))
        pad = np.zeros(reach - 1, U)
        best = sliding(np.concatenate([pad, least, pad]), reach, np.maximum)
        return np.flatnonzero((best == self.phrase) & (self.phrase < FAR))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("d"), F.lit(shards)).cast("int")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 24, digest: bool = False, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """id, n_words, n_removed and the kept text (or only its sha256, as kept_sha256) of every row, and the columns `carry`.

    as_is: a text that loses nothing keeps its white space; null stays null.
    """
    spark = docs.sparkSession
    name = "kept_sha256" if digest else text_col
    if window < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    p = partitions(spark)
    ident = F.col(id_col).cast("long")
    # i goes with its row's text through all steps: rows are never joined by identifier
    row = F.struct(ident.alias("id"), F.col(text_col).isNull().alias("null"), F.struct(*carry).alias("also")) if carry or as_is else ident
    plain = docs.select(row.alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.coalesce(ident, F.lit(NONE)).alias("d"))
    kind_i = plain.schema["i"].dataType
    volume = plain.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    shards = int(max(p, -(-volume // shard_bytes)))
    tasks = min(shards, TASKS)
    near = max(1, math.isqrt(shards))  # shards whose windows meet first

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, HASHED):
                text = Text(part.column(1), window)
                at = text.anchors()
                a, d = text.phrase[at].view(np.int64), part.column(0).to_numpy()[text.row[at]]
                s = part.column(2).to_numpy()[text.row[at]]
                order = np.lexsort((d, a, s))
                a, d, s = a[order], d[order], s[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(a)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(s[first]), pa.array(d[first]), pa.array(d[last] if len(first) else d[:0])], ["a", "s", "lo", "hi"])

    found = plain.select("d", "t", shard_of(shards).alias("s")).mapInArrow(anchors, "a long, s int, lo long, hi long")
    local = written(found.groupBy("a", "s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "anchors")
    recurring = local.groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("a")
    told = local.select("a", "s").join(recurring, "a").select("s", F.lit(0).alias("kind"), "a", F.lit(None).cast(kind_i).alias("i"), F.lit(None).cast("string").alias("t"))
    held = plain.select(shard_of(shards).alias("s"), F.lit(1).alias("kind"), F.col("d").alias("a"), "i", "t")
    task = F.floor(F.col("s").cast("long") * tasks / shards).cast("int")  # dealt by range: none gets two shards before all have one
    dealt = told.unionByName(held).repartitionById(tasks, task).sortWithinPartitions("s", "kind", "a")
    schema = T.StructType([T.StructField(c, k) for c, k in (("kind", T.IntegerType()), ("u", T.LongType()), ("i", kind_i), ("d", T.LongType()), ("a", T.LongType()), ("n", T.LongType()), ("k", T.BinaryType()), ("t", T.StringType()))])

    def shard(no: int, known: np.ndarray, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: settled row (n words, t text or digest). 1: row with candidates (text t, starts settled here k).
        2: windows of document d from start n on, with anchor a and window hashes k, not settled here."""
        import ahocorasick

        parts = [p for b in rows for p in pieces(b, 4, HASHED)]
        type_i = parts[0].schema.field(3).type
        types = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("i", type_i), ("d", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("k", pa.binary()), ("t", pa.string())])
        texts = [Text(p.column(4), window) for p in parts]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        known, phrases, words = np.unique(known), [], []
        seen = np.zeros(len(known), bool)
        for text in texts if len(known) else ():  # each phrase by the words of its first place
            at = text.anchors()
            where = np.minimum(np.searchsorted(known, text.phrase[at]), len(known) - 1)
            new = (known[where] == text.phrase[at]) & ~seen[where]
            which, first = np.unique(where[new], return_index=True)
            seen[which] = True
            for x in at[new][first].tolist():
                automaton.add_word(text.symbols(slice(x, x + PHRASE)), len(phrases))
                phrases.append(int(text.phrase[x]))
                words.append(text.words(x))
        if phrases:
            automaton.make_automaton()
        values = np.array(phrases, U)
        kept, base = [], 0
        for part, text in zip(parts, texts):
            rows_here = part.num_rows
            place = np.full(len(text.phrase), FAR)
            hit = list(automaton.iter(text.symbols())) if phrases and len(text.phrase) else []
            if hit:
                pos, which = np.array(hit, np.int64).T
                pos = (pos + 1) // 2 - PHRASE
                true = text.phrase[pos] == values[which]  # not across rows
                pos, which = pos[true], which[true]
                same = np.fromiter((text.words(x) == words[v] or text.words(x).split() == words[v].split() for x, v in zip(pos.tolist(), which.tolist())), bool, len(pos))
                place[pos[same]] = values[which[same]]
            touched = np.zeros(rows_here, bool)
            if hit:
                least = sliding(place, window - PHRASE + 1, np.minimum)
                start = np.flatnonzero(text.whole & (least < FAR)) if len(least) else np.zeros(0, np.int64)
                if len(start):
                    row = text.row[start]
                    kept.append((least[start], run_hashes(text.h, window)[start], base + row.astype(np.int64), start - text.first[row]))
                    touched[row] = True
            loose = np.flatnonzero(~touched)
            if len(loose):
                strings = part.column(4).take(pa.array(loose)).to_pylist()
                joined = [t.encode() if as_is else b" ".join(t.encode().split()) for t in strings]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(loose), np.int32)), pa.nulls(len(loose), pa.int64()), part.column(3).take(pa.array(loose)), pa.nulls(len(loose), pa.int64()), pa.nulls(len(loose), pa.int64()), pa.array(text.count[loose]), pa.nulls(len(loose), pa.binary()), pa.array([hashlib.sha256(j).hexdigest() if digest else j.decode() for j in joined], pa.string())], schema=types)
            base += rows_here
        texts.clear()
        if not kept:
            return
        a, w, r, s = (np.concatenate(x) for x in zip(*kept))
        doc = np.concatenate([p.column(2).to_numpy() for p in parts])
        order = np.lexsort((doc[r], w, a))
        a, w, r, s = a[order], w[order], r[order], s[order]
        group = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])) - 1 if len(a) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(a) else group
        settled = doc[r] > doc[r[first]][group] if len(a) else np.zeros(0, bool)
        order = np.lexsort((s[settled], r[settled]))
        gone_row, gone = r[settled][order], s[settled][order].astype(np.int32)
        base = 0
        touched = np.unique(r)
        lo, hi = np.searchsorted(gone_row, touched), np.searchsorted(gone_row, touched, "right")
        for part in parts:
            here = np.flatnonzero((touched >= base) & (touched < base + part.num_rows))
            if len(here):
                pick = pa.array(touched[here] - base)
                m = len(here)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(no * (1 << 32) + touched[here]), part.column(3).take(pick), part.column(2).take(pick), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([gone[x:y].tobytes() for x, y in zip(lo[here].tolist(), hi[here].tolist())], pa.binary()), part.column(4).take(pick)], schema=types)
            base += part.num_rows
        a, w, r, s = a[~settled], w[~settled], r[~settled], s[~settled]
        order = np.lexsort((s, r))
        a, w, r, s = a[order], w[order], r[order], s[order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(a)))
        for x in range(0, len(cut), 50_000):
            c, z = cut[x : x + 50_000], size[x : x + 50_000]
            m = len(c)
            bounds = np.concatenate([[0], np.cumsum(8 * z)]).astype(np.int32)
            block = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(w[c[0] : c[0] + int(z.sum())].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 2, np.int32)), pa.array(no * (1 << 32) + r[c]), pa.nulls(m, type_i), pa.array(doc[r[c]]), pa.array(a[c].view(np.int64)), pa.array(s[c].astype(np.int64)), block, pa.nulls(m, pa.string())], schema=types)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, known, rows = None, [], []
        for batch in batches:  # sorted by shard, phrases before documents
            s = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for x, y in zip(cuts, cuts[1:]):
                if no is not None and no != int(s[x]):
                    if rows:
                        yield from shard(no, np.concatenate(known) if known else np.zeros(0, U), rows)
                    known, rows = [], []
                no = int(s[x])
                part = batch.slice(x, y - x)
                kind = part.column(1).to_numpy()
                split = int(np.searchsorted(kind, 1))
                if split:
                    known.append(part.column(2).slice(0, split).to_numpy().view(U))
                if split < part.num_rows:
                    rows.append(part.slice(split))
        if rows:
            yield from shard(no, np.concatenate(known) if known else np.zeros(0, U), rows)

    scanned = written(dealt.mapInArrow(scan, schema), "scanned")
    drop(local)

    run_types = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("d", pa.int64()), ("u", pa.int64()), ("n", pa.int64()), ("k", pa.binary())])
    run_schema = "kind int, a long, d long, u long, n long, k binary"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: starts k, in row u, of windows that a smaller document holds too. kind 2: windows that are left, as they came."""
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, group, doc, u, at = (t.column(k).to_numpy() for k in range(5))
            blob = t.column(5).to_pylist()
            z = np.fromiter(map(len, blob), np.int64, len(blob)) // 8
            w = np.frombuffer(b"".join(blob), U)
            row = np.repeat(np.arange(len(z)), z)
            start = at[row] + ragged(np.zeros(len(z), np.int64), z)
            key = np.cumsum(np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])]))
            order = np.lexsort((doc[row], w, key[row]))
            row, w, start = row[order], w[order], start[order]
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (key[row[1:]] != key[row[:-1]])])
            late = doc[row] > doc[row[np.flatnonzero(new)[np.cumsum(new) - 1]]]
            gone, begin = u[row[late]], start[late].astype(np.int32)
            order = np.argsort(gone, kind="stable")
            gone, begin = gone[order], begin[order]
            cut = np.flatnonzero(np.concatenate([[True], gone[1:] != gone[:-1]])) if len(gone) else np.zeros(0, np.int64)
            ends, m = np.append(cut[1:], len(gone)), len(cut)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(gone[cut]), pa.nulls(m, pa.int64()), pa.array([begin[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist())], pa.binary())], schema=run_types)
            row, w, start = row[~late], w[~late], start[~late]
            order = np.lexsort((start, row))
            row, w, start = row[order], w[order], start[order]
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
            ends, m, r = np.append(cut[1:], len(row)), len(cut), row[cut]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 2, np.int32)), pa.array(anchor[r]), pa.array(doc[r]), pa.array(u[r]), pa.array(start[cut]), pa.array([w[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist())], pa.binary())], schema=run_types)

        for batch in batches:  # sorted by anchor and group; the last one may go on in the next batch
            held.append(batch)
            t = pa.Table.from_batches(held)
            if not t.num_rows:
                held = []
                continue
            anchor, group = t.column(0).to_numpy(), t.column(1).to_numpy()
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])) + 1
            if len(new):
                yield from done(t.slice(0, int(new[-1])))
                held = t.slice(int(new[-1])).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    def met(rows: DataFrame) -> DataFrame:
        """rows: a, g, d, u, n, k; those of one a and g meet."""
        return rows.repartition(p, "a", "g").sortWithinPartitions("a", "g").mapInArrow(settle, run_schema)

    windows = scanned.filter("kind = 2").select("a", F.floor(F.shiftright("u", 32) / near).cast("long").alias("g"), "d", "u", "n", "k")
    by_group = written(met(windows), "by_group")
    left = by_group.filter("kind = 2").select("a", "d", "u", "n", "k")
    # written, so that the join below may broadcast it if it is small, and else split a hot anchor
    hot = left.groupBy("a").agg(F.sum(F.length("k") / 8).alias("z")).filter(F.col("z") > HOT).select("a", F.ceil(F.col("z") * 4 / HOT).cast("long").alias("buckets"))
    left = left.join(written(hot, "hot"), "a", "left")
    each = left.filter("buckets is not null").select("*", F.explode(F.expr("sequence(0, int(length(k) / 8) - 1)")).alias("j"))
    each = each.withColumn("k", F.expr("substring(k, 8 * j + 1, 8)")).withColumn("n", F.col("n") + F.col("j")).withColumn("g", F.pmod(F.xxhash64("k"), F.col("buckets")))
    columns = ["a", "g", "d", "u", "n", "k"]
    whole = left.filter("buckets is null").withColumn("g", F.lit(0).cast("long"))
    late = by_group.unionByName(met(whole.select(*columns).unionByName(each.select(*columns)))).filter("kind = 0")
    late = late.select("u", F.lit(0).alias("kind"), "k", F.lit(None).cast(kind_i).alias("i"), F.lit(None).cast("string").alias("t"))
    open_rows = scanned.filter("kind = 1").select("u", "kind", "k", "i", "t")
    result = T.StructType([T.StructField("i", kind_i), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("t", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, starts = None, []
        for batch in batches:  # sorted by row, starts before the row itself
            out = ([], [], [], [])
            for at_row, (u, kind, k, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
                if u != mine:
                    mine, starts = u, []
                starts.append(np.frombuffer(k, np.int32))
                if not kind:
                    continue
                words = t.encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.concatenate(starts)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                text = t.encode() if as_is and not gone.any() else b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                for column, value in zip(out, (at_row, len(words), int(gone.sum()), hashlib.sha256(text).hexdigest() if digest else text.decode())):
                    column.append(value)
            made = [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(3).take(made[0]), *made[1:]], ["i", "n_words", "n_removed", "t"])

    changed = late.unionByName(open_rows).repartition(p, "u").sortWithinPartitions("u", "kind").mapInArrow(cut, result)
    same = scanned.filter("kind = 0").select("i", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "t")
    out = changed.unionByName(same)
    if not carry and not as_is:
        return out.select(F.col("i").alias(id_col), "n_words", "n_removed", F.col("t").alias(name))
    text = F.when(F.col("i.null"), F.lit(None)).otherwise(F.col("t")) if as_is and not digest else F.col("t")
    return out.select(F.col("i.id").alias(id_col), "n_words", "n_removed", text.alias(name), *[F.col(f"i.also.{c}").alias(c) for c in carry])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what is left of their texts, and its length as n_chars where there is such a column; a text that loses nothing stays as it is."""
    # the row's own columns go along under other names, its identifier in its own type too
    named = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c != "text"}
    plain = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in named.items() if c != "doc_id"], F.col("doc_id").alias(named["doc_id"]))
    out = remove_repeats(plain, carry=tuple(named.values()), as_is=True)
    new = {"text": F.col("text")}
    if "n_chars" in named:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col(named["n_chars"])).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[(new[c] if c in new else F.col(named[c])).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM v JOIN f USING (h) WHERE doc_id > least),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
o AS (SELECT p.doc_id, count(g.p) AS gone, string_agg(x, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)
"""
