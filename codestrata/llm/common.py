"""What several operators share: reading, words, exact ranks over hash cells, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import ensure_checkpoint_dir

#: Rows that one cell of a ranking should hold; a cell is what one task sorts at a time.
CELL_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: splitting bytes cuts at exactly these six characters."""
    return text.encode().split() if text else []


def texts(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one at a time; null is the empty text."""
    for value in column:
        yield value.as_py() or ""


def cells(df: DataFrame, rows: int = CELL_ROWS) -> int:
    """How many hash cells give about ``rows`` rows each."""
    return max(1, -(-df.count() // rows))


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles, whatever size Spark expects: it does not see what an explode multiplies, nor what a file holds
    unpacked, and a side that it takes for small goes through the driver."""
    return left.join(right.hint("merge"), on, how)


def running(df: DataFrame, keys: list[str], cell: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same keys before this one in (cell, order).

    A key may hold any share of the rows: tasks only order one cell at a time, and one row per cell is
    ordered per key. ``keys`` and ``cell`` must not be null.
    """
    group = [*keys, cell]
    d = df.withColumn("_value", value)
    before = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1) if keys else W.orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*group).agg(F.sum("_value").alias("_total"))
    starts = totals.select(*group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    local = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    return merged(d, starts, group).withColumn(name, F.col("_before") + F.col("_start")).drop("_value", "_before", "_start")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: no lineage, and sizes as they are."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it is linked with.

    Alternates two steps until nothing changes: every node hangs its larger neighbours, then its smaller
    ones, on the smallest it knows. Rounds grow with the logarithm of the nodes. Minima are aggregates,
    so a node with very many neighbours is no group in one task. Every round is written and read again: a
    checkpoint would carry on size estimates, whose digits double with each join.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = written(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        hung = merged(pairs, least, "a").where((F.col("b") > F.col("a")) if large else (F.col("b") != F.col("m")))
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:  # the node itself hangs on its minimum too
            out = out.union(least.where("a != m").select("a", F.col("m").alias("b")))
        return out.distinct()

    def state(pairs: DataFrame) -> tuple:
        r = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = star(both, True)  # every pair points from the larger to the smaller
        e = written(star(e, False))
        now = state(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
