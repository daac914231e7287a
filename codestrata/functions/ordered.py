"""Order-dependent measures without a single-task sort.

Rows are range partitioned by (key, order), so a key that holds a third of all rows is cut
into as many chunks as its size asks for. Chunk totals are tiny; their prefix sums turn
chunk-local results into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def chunked(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``: consecutive ranges of (keys, order), fixed by a checkpoint.

    The range bounds come from a sample, so the assignment is written once and read back;
    recomputing it after a lost executor could move a bound.
    """
    cols = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(chunks, *cols) if chunks else df.repartitionByRange(*cols)
    return cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], chunks: int | None = None) -> DataFrame:
    """Running sums per key in order; ``order`` must be unique within a key for exact ties.

    Adds each name of ``sums`` as the sum over all rows up to and including the current one.
    """
    d = chunked(df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()]), keys, order, chunks)
    local = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = d.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in sums]).join(offsets, [*keys, "_chunk"])
    drop = ["_chunk", *[f"_{p}_{n}" for p in "vlo" for n in sums]]
    return out.select("*", *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]).drop(*drop)


def position(df: DataFrame, order: list[Column], name: str = "position", chunks: int | None = None) -> DataFrame:
    """0-based global position in ``order`` (a total order), without one global sort task."""
    ranged = df.repartitionByRange(chunks, *order) if chunks else df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    # the id is (partition << 33) + row: both halves are read back from the checkpoint
    d = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    d = d.withColumn("_chunk", F.shiftright("_mid", 33)).withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row per partition: bounded by the partition count, so one task orders it
    counts = d.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return d.join(F.broadcast(offsets), "_chunk").withColumn(name, F.col("_row") + F.col("_o")).drop("_chunk", "_row", "_mid", "_o")
