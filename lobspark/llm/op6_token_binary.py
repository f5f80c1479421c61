"""Token-ID files: Arrow IPC files of fixed-size lists, readable at any sequence without copying.

Documents are range-partitioned by identifier. Each partition writes one pair of files in the shared folder:
`ids-<part>.arrow`, whose record batches hold `ids` fixed_size_list<uint16 or uint32>[length] and `mask`
fixed_size_list<bool>[length], so that sequence k of a memory-mapped file is a slice; and `docs-<part>.arrow`
with doc_id, start and n_tokens of its documents. A file's own token stream starts at 0, its last sequence is
padded with 0 and masked. `manifest.json` holds every part's tokens and sequences; its prefix sums place a
file's tokens among all. A file is written under a private name and renamed, so a task that runs again leaves
the same files. The folder may be any that pyarrow.fs opens.

Null text counts as empty and holds only its end id. Null identifiers come first. Rows that repeat an
identifier stay side by side in the scan's order after sorting. Other columns are ignored. An empty table
gives files without sequences.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op9_packing import vocabulary, with_end, word_bpe
from .store import partitions, scratch, tidy
from .textnum import pieces

BATCH = 256  # sequences in a record batch


def folder(url: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in url and not url.startswith("file:"):
        return pafs.LocalFileSystem(), url
    if url.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    return pafs.FileSystem.from_uri(url)


def write_token_files(docs: DataFrame, path: str, url: str, length: int = 2048, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Write the files under `url`; returns part, tokens, sequences of each file (one row a file)."""
    spark = docs.sparkSession
    fs, root = folder(url)
    fs.create_dir(root, recursive=True)
    ids_type = pa.uint16() if word_bpe(path).whole.get_vocab_size() <= 1 << 16 else pa.uint32()
    kind = np.dtype("<u2" if ids_type == pa.uint16() else "<u4")
    schema = pa.schema([("ids", pa.list_(ids_type, length)), ("mask", pa.list_(pa.bool_(), length))])
    index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part_no = word_bpe(path), TaskContext.get().partitionId()
        fs, root = folder(url)
        mine = uuid.uuid4().hex
        temp = [f"{root}/.{mine}-{what}" for what in ("ids", "docs")]
        total = sequences = 0
        rest = np.zeros(0, kind)

        def batch_of(flat: np.ndarray, real: int) -> pa.RecordBatch:
            mask = np.arange(len(flat)) < real
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat, ids_type), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)

        with fs.open_output_stream(temp[0]) as a, fs.open_output_stream(temp[1]) as b, pa.ipc.new_file(a, schema) as ids_file, pa.ipc.new_file(b, index) as docs_file:
            for batch in batches:
                for part in pieces(batch, 1):
                    ids, n = with_end(*bpe.encode([t or "" for t in part.column(1).to_pylist()]), end_id)
                    docs_file.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(total + np.cumsum(n) - n), pa.array(n, pa.int64())], schema=index))
                    total += len(ids)
                    rest = np.concatenate([rest, ids.astype(kind)])
                    full = len(rest) // length * length
                    for k in range(0, full, BATCH * length):
                        flat = rest[k : min(full, k + BATCH * length)]
                        ids_file.write_batch(batch_of(flat, len(flat)))
                    sequences += full // length
                    rest = rest[full:]
            if len(rest):
                ids_file.write_batch(batch_of(np.concatenate([rest, np.zeros(length - len(rest), kind)]), len(rest)))
                sequences += 1
        for what, name in zip(temp, ("ids", "docs")):
            fs.move(what, f"{root}/{name}-{part_no:06d}.arrow")
        yield pa.RecordBatch.from_pydict({"part": [part_no], "tokens": [total], "sequences": [sequences]}, schema=pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("sequences", pa.int64())]))

    ordered = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).repartitionByRange(parts or max(2, partitions(spark)), "i").sortWithinPartitions("i")
    tidy(docs.sparkSession)
    made = ordered.mapInArrow(run, "part int, tokens long, sequences long")
    rows = sorted(tuple(r) for r in made.collect())  # one row for each file
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"length": length, "parts": [{"part": p, "tokens": t, "sequences": s} for p, t, s in rows]}).encode())
    return spark.createDataFrame(rows or [], "part int, tokens long, sequences long")


def sequence(url: str, part: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence k of a file and its mask, by random access; the ids are a view of the mapped file where it is local."""
    fs, root = folder(url)
    name = f"{root}/ids-{part:06d}.arrow"
    source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
    reader = pa.ipc.open_file(source)
    at = 0
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        if k < at + batch.num_rows:
            ids, mask = batch.column(0), batch.column(1)
            n = ids.type.list_size
            return ids.values.to_numpy()[(k - at) * n : (k - at + 1) * n], mask.values.slice((k - at) * n, n).to_numpy(zero_copy_only=False)
        at += batch.num_rows
    raise IndexError(k)


def read_token_files(spark: SparkSession, url: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    fs, root = folder(url)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    base, rows = 0, []
    for p in parts:
        rows.append((p["part"], base))
        base += p["tokens"]
    if not rows:
        return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = folder(url)
        for batch in batches:
            for part_no, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where = [f"{root}/{name}-{part_no:06d}.arrow" for name in ("docs", "ids")]
                opened = [pa.memory_map(w) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(w) for w in where]
                index, ids = (pa.ipc.open_file(o) for o in opened)
                have, at, b = np.zeros(0, np.uint32), 0, 0  # ids not used yet, from token `at` on
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    start, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crc = []
                    for s, m in zip(start.tolist(), n.tolist()):
                        more = [have]
                        size = len(have)
                        while at + size < s + m:
                            got = ids.get_batch(b)
                            b += 1
                            more.append(got.column(0).values.to_numpy()[got.column(1).values.to_numpy(zero_copy_only=False)].astype("<u4"))
                            size += len(more[-1])
                        if len(more) > 1:
                            have = np.concatenate(more)
                        crc.append(zlib.crc32(have[s - at : s - at + m].tobytes()))
                        if s + m - at > 1 << 20:
                            have, at = have[s + m - at :], s + m
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base + start), pa.array(n), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "part int, base long").repartition(len(rows), "part")
    return files.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = scratch(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), url)
    return read_token_files(spark, url)


ORACLE = None
