"""BPE encoding and decoding with a byte-level vocabulary by batched numpy merge rounds (`bpe.ByteBpe`).

A map over Arrow batches: no shuffle, memory bounded by a chunk of texts (or one text) and the piece cache.
Null text counts as empty: no ids, empty decoded text. Rows keep their identifier whatever it is, null and
repeated ones too; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBpe
from .store import tidy
from .textnum import pieces

_made: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer a worker."""
    if path not in _made:
        _made[path] = ByteBpe(path)
    return _made[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for part in pieces(batch, 1):
                ids, n = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))], [id_col, "ids"])

    tidy(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded string of every row of ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            lists = batch.column(1)
            n = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            out = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in out], pa.string())], [id_col, "decoded"])

    tidy(encoded.sparkSession)
    return encoded.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` long, decoded string")


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded from those ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for part in pieces(batch, 1):
                ids, n = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
                decoded = bpe.decode(ids.astype(np.int64), n)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([sha(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.string()), pa.array(list(map(sha, decoded)), pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    tidy(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))


ORACLE = None
