"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import linededup, mixing, neardup, packing, quality
from codestrata.session import ensure_checkpoint_dir

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", linededup.stage),
    ("near dedup", neardup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The first stage asks a fitted model, which SQL cannot state; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all of ``documents``; stages hand on Parquet in the shared checkpoint folder."""
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{root}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
