"""Sharding by vector bin packing: bytes, tokens and rows of all shards in balance together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import CELL_ROWS, cells, running, table, written

SHARDS = 8
#: Groups under 1 / (shards * FINE) of the whole are placed together with others, in this many cells per shard.
FINE = 64
CELLS = 512


def place(items: np.ndarray, shards: int) -> list[int]:
    """A shard for each item (rows of several sizes), largest first: where size times residual room is most.

    Sizes and rooms are parts of the total of their kind; room may run below zero.
    """
    total = items.sum(axis=0, dtype=np.float64)
    share = items / np.where(total > 0, total, 1)
    room = np.full((shards, items.shape[1]), 1 / shards)
    out = [0] * len(items)
    for i in np.lexsort((np.arange(len(items)), -share.sum(axis=1))):
        k = int(np.argmax(room @ share[i]))
        out[i] = k
        room[k] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), n_tokens, text_crc32, shard, slot of every row.

    Rows of equal text are one group and stay together. A group over 1 / (shards * ``FINE``) of all bytes,
    tokens or rows is placed alone, cut by doc_id (equal rows by number) into parts of about that size, since a shard may not be
    able to take it whole; there are 3 * shards * ``FINE`` such groups at most. The others share hash
    cells, ``CELLS`` a shard. So what is placed, one after the other on the driver, has a bounded number of
    items, whatever the input. ``slot`` counts from 0 without gaps in each shard. Null text has no bytes
    and forms a group with the empty text; a very long text is one row like others; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"),
                    F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), F.monotonically_increasing_id().alias("row"))
    d = written(slim)  # texts are read once
    # rows that repeat too often for one cell are told apart by their number; a null leaves the hashes of all others as they are
    crowd = d.groupBy("doc_id", "g").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS).select(F.col("doc_id").alias("crowd_id"), F.col("g").alias("crowd_g"))
    d = d.join(crowd, d["doc_id"].eqNullSafe(crowd["crowd_id"]) & (d["g"] == crowd["crowd_g"]), "left")
    d = d.withColumn("salt", F.when(F.col("crowd_g").isNotNull(), F.col("row"))).drop("crowd_id", "crowd_g", "row")
    kinds = {"size": F.sum("size"), "n_tokens": F.sum("n_tokens"), "rows": F.count("*")}
    total = d.agg(*[v.alias(k) for k, v in kinds.items()]).first()
    limit = {k: (total[k] or 0) / (shards * FINE) for k in kinds}
    big = d.groupBy("g", "size", "text_crc32").agg(*[v.alias(f"b_{k}") for k, v in kinds.items()])
    parts = F.greatest(*[F.ceil(F.col(f"b_{k}") / F.lit(max(v, 1.0))) for k, v in limit.items()])
    big = big.where("b_rows > 1").where(" or ".join(f"b_{k} > {v!r}D" for k, v in limit.items()))
    big = big.select("g", "size", "text_crc32", F.least(parts, F.col("b_rows")).cast("bigint").alias("parts"))
    d = d.join(F.broadcast(big), ["g", "size", "text_crc32"], "left")  # 3 * shards * FINE rows at most
    alone = F.col("parts").isNotNull()
    d = d.withColumn("item", F.when(alone, F.col("g")).otherwise(F.pmod("g", F.lit(shards * CELLS))))
    d = d.withColumn("part", F.when(alone, F.pmod(F.xxhash64("doc_id", "salt"), "parts")).otherwise(F.lit(-1)))
    items = d.groupBy("item", "part").agg(*[v.alias(k) for k, v in kinds.items()]).orderBy("item", "part").collect()
    chosen = place(np.array([[r[k] for k in kinds] for r in items], np.float64).reshape(-1, 3), shards)
    plan = docs.sparkSession.createDataFrame([(r["item"], r["part"], s) for r, s in zip(items, chosen)], "item bigint, part bigint, shard int")
    d = d.join(F.broadcast(plan), ["item", "part"])
    d = d.withColumn("cell", F.pmod(F.xxhash64("doc_id", "g", "salt"), F.lit(cells(d))))
    d = running(d, ["shard"], "cell", ["g", "doc_id"], F.lit(1).cast("bigint"), "slot")
    return d.select("doc_id", "size", "n_tokens", "text_crc32", "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
