"""Line dedup over overlapping windows of three consecutive lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage
from .common import merged, table

WINDOW = 3


def strip_lines(text: str, starts, width: int = WINDOW) -> str:
    """``text`` without the lines that the windows starting at ``starts`` cover; overlapping windows merge."""
    lines, kept, at = text.split("\n"), [], 0
    for s in sorted(starts):
        kept += lines[at:s]  # empty if this window begins inside the last one
        at = max(at, s + width)
    return "\n".join(kept + lines[at:])


@F.pandas_udf(T.StringType())
def _strip(text: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or not len(s) else strip_lines(t, s) for t, s in zip(text, starts)], dtype=object)


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of all windows that hold more than blanks; a 128-bit hash stands for one."""
    d = docs.select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("l"))
    w = F.expr(
        "transform(sequence(0, size(l) - 3), i -> if(trim(concat(l[i], l[i + 1], l[i + 2])) = '', null,"
        " named_struct('pos', i, 'h1', xxhash64(l[i], l[i + 1], l[i + 2]), 'h2', xxhash64(7, l[i + 2], l[i + 1], l[i]))))")
    d = d.where(F.size("l") >= WINDOW).select("doc_id", "version", F.explode(w).alias("w")).where("w is not null")
    return d.select("doc_id", "version", "w.pos", "w.h1", "w.h2")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), starts: where windows begin that occurred before, in (doc_id, version, line) order."""
    w = _windows(docs)
    # written once: the join below then reads plain shuffles on both sides, which a very common window can be split in
    first = cut_lineage(w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "pos")).alias("first")).where("n > 1").drop("n"))
    later = merged(w, first, ["h1", "h2"]).where(~F.struct("doc_id", "version", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``text`` without lines that only repeat earlier text, and line_starts.

    A line goes if it lies in a window of three consecutive lines that occurred before: in a smaller
    doc_id, or further up in the same text. Null ids come first. Windows of blank lines never count. A
    text of fewer than three lines, an empty or null text stays as it is; a text of which nothing is new
    becomes empty, its row stays. Rows that agree in doc_id and text are one document and are cut alike.
    """
    starts = repeated_windows(docs).select(F.col("doc_id").alias("_ld_id"), F.col("version").alias("_ld_version"), F.col("starts").alias("_ld_starts"))
    d = merged(docs, starts, docs["doc_id"].eqNullSafe(starts["_ld_id"]) & (F.xxhash64(docs["text"]) == starts["_ld_version"]), "left")
    cols = [_strip(docs["text"], "_ld_starts").alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns]
    return d.select(*cols, F.array_sort(F.coalesce("_ld_starts", F.expr("cast(array() as array<int>)"))).alias("_ld_line_starts"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_windows (repeated windows of the document), n_lines left, and the text that is left."""
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size("_ld_line_starts").cast("bigint").alias("n_windows"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shortened texts; n_chars follows the text."""
    d = dedup_lines(docs).drop("_ld_line_starts")
    return d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else d


OP3_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, lines[i + 1] AS a, lines[i + 2] AS b, lines[i + 3] AS c
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM l)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth
      FROM w WHERE trim(a || b || c) <> ''),
dup AS (SELECT doc_id, i FROM k WHERE nth > 1),
n AS (SELECT doc_id, count(*) AS n_windows FROM dup GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM dup),
u AS (SELECT doc_id, i, lines[i + 1] AS line FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM l)),
kept AS (SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.i) AS text
         FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n.n_windows, 0) AS n_windows,
       coalesce(len(string_split(coalesce(kept.text, ''), chr(10))), 1) AS n_lines, coalesce(kept.text, '') AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
