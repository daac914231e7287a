"""Named queries of the library, wired to the test views."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import ORACLES, QUERIES

_MODULES = ["corpus", "blocks", "graphs", "rollups", "quality", "answers", "teams"]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files ordered by security hits, then complexity: source, projection, scan and top-k in one pass."""
    _load()
    from .corpus import _meta

    top = _meta(spark, sf_dir).orderBy(F.desc("security_hits"), F.desc("cyclomatic"), "file_name").limit(20)
    return top.select("file_name", "language", "security_hits", "performance_hits", "architecture_hits", "cyclomatic", "loc")
