"""Analysis history: append, list, look up, purge.

A store is a folder of batches, each partitioned by day, and a log (``versions``) of which batches and days count.
A purge writes the days that lose rows anew, as one batch, and drops the old ones in the same log entry; all
other files stay as they are, and a reader sees the store before or after it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import versions

_BATCH, _DAY = "store_batch", "created_date"


def _write(rows: DataFrame, path: str) -> str:
    """``rows`` with their day as a new batch that the log does not name yet."""
    batch = uuid.uuid4().hex
    # rows of a day meet, so a day gets a few files; a rebalance may split a large day over tasks
    rows.hint("rebalance", _DAY).write.partitionBy(_DAY).parquet(f"{path}/data/{_BATCH}={batch}")
    return batch


def append_session(sessions: DataFrame, path: str, grain: str = "day") -> None:
    """Append sessions (or their file rows that carry ``created_at``), one folder per day, or per ``grain``."""
    batch = _write(sessions.withColumn(_DAY, F.to_date(F.date_trunc(grain, "created_at"))), path)
    versions.commit(sessions.sparkSession, path, [("add", batch, None)])


def _pairs(dropped: list[tuple[str, str]]) -> Column:
    """Rows of these (batch, day) folders; the filter is on folder names, so other files are not opened."""
    days = defaultdict(list)
    for batch, day in dropped:
        days[batch].append(day)
    text = F.coalesce(F.col(_DAY).cast("string"), F.lit(""))
    return reduce(lambda a, b: a | b, [(F.col(_BATCH) == batch) & text.isin([d or "" for d in ds]) for batch, ds in days.items()], F.lit(False))


def _stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    batches, dropped = versions.live(spark, path, version)
    if not batches:
        raise FileNotFoundError(f"no history under {path}")
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/{_BATCH}={b}" for b in batches])
    rows = rows.withColumn(_BATCH, F.col(_BATCH).cast("string"))
    return rows.where(~_pairs(dropped)) if dropped else rows


def read_sessions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that count now, or did as of an earlier ``version`` of the log."""
    return _stored(spark, path, version).drop(_BATCH)


def recent_sessions(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def session_by_id(sessions: DataFrame, files: DataFrame, session_id: int) -> DataFrame:
    """One session with its file rows; both filters reach the scans."""
    s = sessions.where(F.col("id") == session_id)
    f = files.where(F.col("session_id") == session_id)
    return s.join(f, s["id"] == f["session_id"], "left").drop("session_id")


def _gone(cutoff: str | None, session_id: int | None) -> Column:
    gone = F.lit(False)
    if cutoff is not None:
        gone = gone | (F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz"))
    if session_id is not None:
        gone = gone | (F.col("id") == session_id)
    return F.coalesce(gone, F.lit(False))


def purge(sessions: DataFrame, files: DataFrame, cutoff: str | None = None, session_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays after removing sessions before ``cutoff`` or one id, children included."""
    gone = _gone(cutoff, session_id)
    removed = sessions.where(gone).select(F.col("id").alias("session_id"))
    return sessions.where(~gone), files.join(removed, "session_id", "left_anti")


def _replace(spark: SparkSession, path: str, stored: DataFrame, lost: DataFrame, keep) -> int:
    """Write the (batch, day) folders of ``lost`` anew with the rows that ``keep`` leaves; returns how many those are."""
    touched = [(r[0], r[1] and str(r[1])) for r in lost.select(_BATCH, _DAY).distinct().collect()]  # days, not rows
    if touched:
        kept = keep(stored.where(_pairs(touched))).drop(_BATCH)
        drops = [("drop", batch, day) for batch, day in touched]
        versions.commit(spark, path, [("add", _write(kept, path), None), *drops])
    return len(touched)


def purge_store(spark: SparkSession, sessions_path: str, files_path: str, cutoff: str | None = None, session_id: int | None = None) -> tuple[int, int]:
    """Purge a store in place: how many day folders of sessions and of their files were written anew.

    Only folders that lose rows are read whole and written; of the others one column is looked at. Children go
    first, so a purge that broke off is finished by calling it again. The files of replaced folders stay on
    disk for readers of an earlier version.
    """
    sessions, files = _stored(spark, sessions_path), _stored(spark, files_path)
    gone = _gone(cutoff, session_id)
    removed = sessions.where(gone).select(F.col("id").alias("session_id"))
    n_files = _replace(spark, files_path, files, files.join(removed, "session_id", "left_semi"), lambda rows: rows.join(removed, "session_id", "left_anti"))
    return _replace(spark, sessions_path, sessions, sessions.where(gone), lambda rows: rows.where(~gone)), n_files
