"""Concatenate and cut: two-pass prefix sums give global offsets, fixed windows cut the concatenation.

Pass 1 tokenises every document once and writes ids, the writing partition's number and the tokens before the
document in that partition. The partitions' totals (one row each) are summed in partition order; that is all
that meets in one place. Pass 2 reads the ids back, adds the partition's offset and cuts at multiples of the
sequence length; every piece is a boundary record. Only the last sequence is padded. No row is shuffled.

Null text counts as empty and packs as its end id. Rows with null or repeated identifiers are packed as they
stand. Other columns are ignored; an empty table gives an empty result. The sequence order is the scan's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import WordBpe
from .op10_bpe import vocabulary
from .store import tidy, written
from .textnum import pieces

_made: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One tokenizer a worker."""
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end_id` after each text's."""
    return np.insert(ids, np.cumsum(n), end_id), n + 1


def id_type(path: str) -> np.dtype:
    """Little-endian unsigned ids of 16 bits, of 32 where the vocabulary is larger."""
    return np.dtype("<u2" if word_bpe(path).whole.get_vocab_size() <= 1 << 16 else "<u4")


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, ids (little-endian unsigned 16-bit, 32-bit where the vocabulary is larger), n, part, before: ids before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part_no, before, kind = word_bpe(path), TaskContext.get().partitionId(), 0, id_type(path)
        for batch in batches:
            for part in pieces(batch, 1):
                ids, n = with_end(*bpe.encode([t or "" for t in part.column(1).to_pylist()]), end_id)
                ends = np.cumsum(n)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((kind.itemsize * np.concatenate([[0], ends])).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), raw, pa.array(n, pa.int64()), pa.array(np.full(len(n), part_no, np.int32)), pa.array(before + ends - n, pa.int64())], ["i", "ids", "n", "part", "before"])
                before += int(ends[-1])

    tidy(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "i long, ids binary, n long, part int, before long")


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, seq_tokens (and the ids, if asked for)."""
    tokens = written(tokenized(docs, path, end_id, id_col, text_col), "ids")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each partition of the scan
    base = totals.select("part", (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("base"), F.sum("total").over(W.partitionBy()).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        for batch in batches:
            at = batch.column(3).to_numpy() + batch.column(4).to_numpy()
            n, everything = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin = np.maximum(seq * length, at[row])
            end = np.minimum((seq + 1) * length, (at + n)[row])
            raw = [memoryview(x.as_buffer()) for x in batch.column(1)]
            cut = [np.frombuffer(raw[r], kind)[b:e].astype("<u4") for r, b, e in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist())]
            cols = [batch.column(0).take(pa.array(row)), pa.array(begin - at[row]), pa.array(end - begin), pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length), pa.array(np.minimum(length, everything[row] - seq * length))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seq_tokens"]
            if with_ids:
                cols.append(pa.array([c.astype(np.int32).tolist() for c in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seq_tokens long" + ", ids array<int>" * with_ids
    return tokens.join(F.broadcast(base), "part").select("i", "ids", "n", "before", "base", "all").mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


ORACLE = None
