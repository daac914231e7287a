"""Source trees as tables: one row per file, with failures as rows.

Tasks list folders and read files; the driver never holds a list of paths. A tree is walked level by level: a table
of folders becomes a table of what they hold, whose folders are the next table. Files are then dealt out by bytes.
Where only Spark can open a store (a scheme that pyarrow does not know), Spark's own file index is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import LANGUAGES, any_of, base_name, detect_language, unify_newlines
from ..session import written

SCHEMA = ["path", "modificationTime", "length", "content"]
#: Schemes that tasks open by themselves.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
#: Bytes a reading task is dealt, and what opening a file counts as; bytes of a batch that a task hands on; the largest cell.
BUDGET, OPENING, BATCH, CELL = 128 << 20, 64 << 10, 16 << 20, (1 << 31) - 64
_LISTED = "path string, is_folder boolean, modificationTime timestamp, length bigint, error string"
_READ = "path string, modificationTime timestamp, length bigint, content string, error string"
_STAMP = pa.timestamp("us", "UTC")


def _open(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what comes before a path of it to make a URI again. URIs are plain, not escaped."""
    scheme, rest = uri.split("://", 1)
    fs, path = pafs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/@:')}")
    return fs, path, uri[:len(uri) - len(path)] if uri.endswith(path) else f"{scheme}://"


def _stamp(info: pafs.FileInfo) -> datetime | None:
    return info.mtime if info.mtime_ns else None


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each folder holds; names that begin with a dot or an underscore are passed over, as Spark's readers do."""
    kinds = [pa.string(), pa.bool_(), _STAMP, pa.int64(), pa.string()]
    for b in batches:
        for uri in b.column(0).to_pylist():
            try:
                fs, path, head = _open(uri)
                info = fs.get_file_info(path)
                if info.type == pafs.FileType.Directory:
                    found = fs.get_file_info(pafs.FileSelector(path))
                    found = [i for i in found if not i.base_name.startswith((".", "_"))]
                elif info.type == pafs.FileType.NotFound:
                    raise FileNotFoundError("no such file or folder")
                else:
                    found = [info]
                rows = [(head + i.path, i.type == pafs.FileType.Directory, _stamp(i), i.size, None) for i in found]
            except (OSError, pa.ArrowException) as broken:  # a folder that cannot be listed is a row of its own
                rows = [(uri, False, None, None, f"{type(broken).__name__}: {broken}"[:500])]
            for at in range(0, len(rows), 10_000):
                cols = list(zip(*rows[at:at + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "is_folder", "modificationTime", "length", "error"])


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, error) of every file below ``path``, links to folders included once per path.

    One table per level of the tree is written to the shared checkpoint folder, so a lost executor costs a level.
    """
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    level = spark.createDataFrame([(uri,)], "path string")
    files, slots = None, spark.sparkContext.defaultParallelism
    while True:
        found = written(level.repartition(slots).mapInArrow(_list, _LISTED))
        here = found.where(~F.coalesce("is_folder", F.lit(False))).drop("is_folder")
        files = here if files is None else files.unionByName(here)
        level = found.where("is_folder").select("path")
        if level.isEmpty():
            return files


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content of listed files as text; what cannot be read or does not fit into a cell is told in ``error``."""
    kinds = [pa.string(), _STAMP, pa.int64(), pa.string(), pa.string()]
    names = ["path", "modificationTime", "length", "content", "error"]
    for b in batches:
        rows, held = [], 0
        for uri, stamp, length, error in zip(*[c.to_pylist() for c in b.columns]):
            content = None
            if error is None:
                try:
                    if length is not None and length > CELL:
                        raise ValueError("file does not fit into a cell")
                    fs, path, _ = _open(uri)
                    with fs.open_input_stream(path) as f:
                        content = f.read().decode("utf-8-sig", "replace")
                except (OSError, ValueError, pa.ArrowException) as broken:
                    error = f"{type(broken).__name__}: {broken}"[:500]
            rows.append((uri, stamp, length, content, error))
            held += len(content or "")
            if held >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _by_tasks(spark: SparkSession, path: str, extensions, cap: int | None) -> DataFrame:
    files = list_tree(spark, path).where(any_of([F.lower("path").endswith("." + e) for e in extensions]) | F.col("error").isNotNull())
    too_large = F.lit(None).cast("string") if cap is None else F.when(F.col("length") > cap, F.format_string("file exceeds %d bytes", F.lit(cap)))
    files = files.withColumn("error", F.coalesce("error", too_large))
    cost = F.when(F.col("error").isNull(), F.coalesce("length", F.lit(0))).otherwise(0) + OPENING
    total = files.agg(F.sum(cost)).first()[0] or 0
    return files.repartition(max(1, -(-total // BUDGET))).mapInArrow(_read, _READ)


def _by_index(spark: SparkSession, path: str, extensions, cap: int | None) -> DataFrame:
    """Through Spark's file index, for stores that only Spark opens; files of no length come from that index."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = raw.where(any_of([F.lower("path").endswith("." + e) for e in extensions]))
    error = F.lit(None).cast("string")
    parts = [raw.select(*SCHEMA, error.alias("error"))]
    if cap is not None:
        parts = [raw.where(F.col("length") <= cap).select(*SCHEMA, error.alias("error")),
                 raw.where(F.col("length") > cap).select(*SCHEMA[:3], F.lit(None).cast("binary").alias("content"), F.lit(f"file exceeds {cap} bytes").alias("error"))]
    named = spark.createDataFrame([(p,) for p in raw.inputFiles()], "uri string").where(any_of([F.lower("uri").endswith("." + e) for e in extensions]))
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    named = named.select(F.regexp_replace(plain, "^file:/+", "file:/").alias("path"))
    empty = named.join(raw.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")), "path", "left_anti")
    parts.append(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"), error.alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("content", F.decode("content", "UTF-8"))


def read_corpus(spark: SparkSession, path: str, extensions=tuple(LANGUAGES), max_mb: float | None = None, keep_empty: bool = True) -> DataFrame:
    """Read a tree of source files, whole: one row per file, also for files of no length.

    A file that cannot be read, a folder that cannot be listed and, with ``max_mb``, a larger file keep a row with
    status Error and no content. Bytes that are no UTF-8 become replacement signs. ``keep_empty=False`` leaves
    out files of no length.
    """
    cap = None if max_mb is None else int(max_mb * 1024 * 1024)
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"
    raw = (_by_tasks if scheme in SCHEMES else _by_index)(spark, path, extensions, cap)
    if not keep_empty:
        raw = raw.where(F.coalesce("length", F.lit(1)) > 0)
    return raw.select(
        base_name(F.col("path")).alias("file_name"), F.col("path"), unify_newlines(F.col("content")).alias("content"), F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"), detect_language(F.col("path")).alias("language"),
        F.when(F.col("error").isNull(), "Completed").otherwise("Error").alias("status"), "error")
