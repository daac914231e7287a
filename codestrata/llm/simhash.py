"""SimHash near-dedup: candidates by pigeonring chains, an exact Hamming check, components.

The 64 bits stand in a ring of 16 segments of 4 bits. If two fingerprints differ in at most 3 bits, some
start on the ring begins a chain in which the first l segments together differ in at most 3 l / 16 bits,
for every l. So the first five segments (20 bits) are equal, and the next five differ in one bit at most,
hence the first two or the last three of those are equal, too. For every start both ways give a key of 28
or 32 equal bits that such pairs share in at least one place. Only pairs under one key are held against
the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import components, merged, table, texts

BITS, WIDTH, DISTANCE = 64, 3, 3
SEGMENTS = 16
STEP = BITS // SEGMENTS
#: Fingerprints under one key that one comparison holds; longer lists are compared block by block.
BLOCK = 512
#: Shingles counted at a time, so that a very long text needs no more memory than this.
CHUNK = 65_536


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, most significant first."""
    raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bits set in over half of the XXH64 (seed 42) of all shingles of ``width`` words; a text without words gives 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    last = ends[width - 1:].tolist() if len(w) >= width else [len(line)]
    first = [0, *(ends[:len(last) - 1] + 1).tolist()]
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(last), CHUNK):
        count += _bits([digest(line[a:b], 42) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])])
    return int.from_bytes(np.packbits(2 * count > len(last)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t) for t in texts(b.column(1))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def chain_keys(fp: Column) -> Column:
    """All chain keys: (key number, its equal bits), the bits read round the ring from each start."""
    out = []
    for s in range(SEGMENTS):
        turn = s * STEP
        ring = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn)) if turn else fp
        head = F.shiftrightunsigned(ring, BITS - 20)
        low = F.shiftrightunsigned(ring, BITS - 40)
        for half, part in enumerate((F.shiftrightunsigned(low, 12).bitwiseAND(F.lit(0xFF)), low.bitwiseAND(F.lit(0xFFF)))):
            out.append(F.shiftleft(F.lit(2 * s + half).cast("bigint"), 40).bitwiseOR(F.shiftleft(head, 12)).bitwiseOR(part.cast("bigint")))
    return F.array(*out)


def spanning(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs within ``DISTANCE`` that link all such pairs link: one fewer than a linked group has members."""
    bits = fp.view(np.uint64)  # of signed numbers, numpy would count the bits of the absolute value
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= DISTANCE
    free, u, v = np.ones(len(fp), bool), [], []
    for start in range(len(fp)):
        if not free[start]:
            continue
        free[start], todo = False, [start]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(close[i] & free)
            free[new] = False
            todo += new.tolist()
            u += [int(fp[i])] * len(new)
            v += fp[new].tolist()
    return u, v


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        us, vs = [], []
        for lows, highs in zip(b.column(0), b.column(1)):
            u, v = spanning(np.array(lows.as_py() + highs.as_py(), np.int64))
            us += u
            vs += v
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of ``fp`` within the distance that keep together all that such pairs link.

    A key shared by more than ``BLOCK`` fingerprints is dealt into blocks; every pair of blocks is one
    comparison in one row of bounded size, and yields linking pairs only, never all pairs.
    """
    keys = distinct.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    shared = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    keys = merged(keys, shared, "key").withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
    keys = keys.withColumn("mine", F.pmod(F.xxhash64("fp", "key"), "blocks"))
    keys = keys.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    keys = keys.select("fp", "key", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    lists = keys.groupBy("key", "lo", "hi").agg(F.array_sort(F.collect_list(F.when(F.col("mine") == F.col("lo"), F.col("fp")))).alias("l"),
                     F.array_sort(F.collect_list(F.when(F.col("mine") != F.col("lo"), F.col("fp")))).alias("r"))
    lists = lists.select(F.col("l"), F.col("r")).where("size(l) + size(r) > 1").distinct()  # near pairs share many keys
    return lists.mapInArrow(_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id that links of at most 3 bits reach.

    Null and empty texts have fingerprint 0 and are linked like any other; equal rows stay as many rows; a
    component without any doc_id has a null component_id; an empty table gives an empty result; other
    columns are not read.
    """
    fps = cut_lineage(fingerprints(docs))
    least = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(least.select("fp")))
    named = merged(least, member, least["fp"] == member["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    label = cut_lineage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    fp_label = cut_lineage(merged(named, label, "root").select("fp", "component_id"))
    return merged(fps, fp_label, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
