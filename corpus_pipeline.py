"""The corpus pipeline: documents through quality rules, near-dedup, substring dedup, mixing and encoding.

Each stage takes all that the one before it kept, written as Parquet in the shared
folder and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quaestor.llm import op01_mixing, op02_simhash, op05_quality, op06_sentencepiece, op08_substring
from quaestor.llm.common import shared_dir

STAGES = [
    ("quality", op05_quality.stage),
    ("near_dedup", op02_simhash.stage),
    ("substring_dedup", op08_substring.stage),
    ("mixing", op01_mixing.stage),
    ("encoding", op06_sentencepiece.stage),
]

#: SQL can't express the fingerprints, the chunks, the draws and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
