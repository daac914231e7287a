"""Which folders of a store count: an append-only log of small rows that readers follow.

A commit is one append of rows, so it is there as a whole or not at all, on any file system that Spark writes. Data
folders that no log row names (of a job that failed, say) are never read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Row, SparkSession

_LOG = "version bigint, op string, batch string, day string"


def log(spark: SparkSession, root: str) -> list[Row]:
    """All log rows in order; none where there is no store. One row per append and per replaced day."""
    try:
        rows = spark.read.schema(_LOG).parquet(f"{root}/log").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r.version, r.op, r.batch, r.day or ""))


def commit(spark: SparkSession, root: str, ops: list[tuple[str, str, str | None]]) -> int:
    """Append (op, batch, day) rows as one version: ``add`` a batch, or ``drop`` a day of one. Returns the version."""
    version = max((r.version for r in log(spark, root)), default=0) + 1
    spark.createDataFrame([(version, *op) for op in ops], _LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return version


def live(spark: SparkSession, root: str, version: int | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """(batches that were added, their days that were dropped) as of ``version``."""
    rows = [r for r in log(spark, root) if version is None or r.version <= version]
    return [r.batch for r in rows if r.op == "add"], [(r.batch, r.day) for r in rows if r.op == "drop"]
