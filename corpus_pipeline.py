"""A corpus run: toxicity, exact dedup, n-gram Jaccard join, substring dedup, packing.

Each stage reads what the stage before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lobspark.llm import op1_ngram_jaccard, op2_substring_dedup, op3_toxicity, op4_exact_dedup, op9_packing
from lobspark.llm.store import written

STAGES = [
    ("toxicity", op3_toxicity.stage),
    ("exact_dedup", op4_exact_dedup.stage),
    ("ngram_jaccard", op1_ngram_jaccard.stage),
    ("substring_dedup", op2_substring_dedup.stage),
    ("packing", op9_packing.stage),
]

#: Models, whole-text tokenisation and window removal can't be stated in SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
