"""Document fingerprints by Order MinHash: sketches that follow edit distance, not only the set of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

#: Tuples in a fingerprint, k-mers in a tuple, characters in a k-mer (a power of two).
TUPLES, PICKS, K = 64, 2, 16
#: Values hashed at a time; bounds the memory for a very long text.
VALUES = 1 << 18
_MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, TUPLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters of a range of documents that one task compares neighbour by neighbour.
RANGE_CHARS = 64_000_000


def _numbered(text: str) -> np.ndarray:
    """One 64-bit hash for every k-mer and the number of its occurrence, in text order.

    A k-mer ends at every character; before the text stand ``K`` - 1 zeros, so that the first characters,
    and texts of fewer than ``K``, have k-mers too. Hashes of doubled width come from two of half the width.
    """
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n, h = len(h), np.concatenate([np.zeros(K - 1, np.uint64), h])
    width = 1
    while width < K:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ h[width:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        width *= 2
    h = h ^ (h >> np.uint64(32))
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    nth = np.empty(n, np.uint64)
    nth[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    h = (h + nth * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str | None) -> str:
    """``TUPLES`` times four hex digits; an empty text gives zeros.

    Each tuple has a hash order of its own over the numbered k-mers. It takes the ``PICKS`` smallest, puts
    them back into text order and hashes their sequence. A text of fewer k-mers uses all it has.
    """
    if not text:
        return "0" * (4 * TUPLES)
    h = _numbered(text)
    n, picks = len(h), min(PICKS, len(h))
    best = np.empty((TUPLES, picks), np.int64)
    step = max(1, VALUES // n)
    for at in range(0, TUPLES, step):
        r = h[None, :] ^ _MIX[0, at:at + step, None]
        r *= _MIX[1, at:at + step, None]
        for p in range(picks):
            i = r.argmin(axis=1)
            best[at:at + step, p] = i
            r[np.arange(len(i)), i] = np.uint64(0xFFFFFFFFFFFFFFFF)
    best.sort(axis=1)
    out = np.zeros(TUPLES, np.uint64)
    for p in range(picks):
        out = (out ^ h[best[:, p]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return (out >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal tuples, and of that the root that undoes their width: 1 for equal texts, near 0 for strangers."""
    same = sum(a[i:i + 4] == b[i:i + 4] for i in range(0, 4 * TUPLES, 4))
    return (same / TUPLES) ** (1 / PICKS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row; null text counts as empty; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [x.as_py() or "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in t], pa.int64()), pa.array([fingerprint(x) for x in t], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as many characters (or all) of the text ``after`` it."""
    third = len(text) // 3
    return text[:len(text) - third] + after[:third]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges in: (range, doc_id, text, tail). Every row but a range's tail comes out against the row after it."""
    last: tuple | None = None  # the row that waits for the one after it: range, doc_id, text, fingerprint

    for b in batches:
        ids, out = [], []
        for part, doc, text, tail in zip(*[b.column(i) for i in range(4)]):
            part, doc, text, tail = part.as_py(), doc, text.as_py() or "", tail.as_py()
            if last and last[0] == part:
                known = last[2] == text
                fp = last[3] if known else fingerprint(text)
                ids.append(last[1])
                out.append(_row(last[2], last[3], text, fp))
            else:
                fp = fingerprint(text)
            last = None if tail else (part, doc, text, fp)
        kind = b.schema.field(1).type
        cols = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], kind), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                         ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _row(text: str, fp: str, after: str, after_fp: str) -> tuple:
    e = edited(text, after)
    e_fp = fp if e == text else fingerprint(e)
    return len(text), hashlib.sha256(e.encode()).hexdigest(), fp, e_fp, likeness(fp, e_fp), likeness(fp, after_fp)


def compare_neighbours(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Every text against its edited form and the next document, by descending doc_id, the first after the last.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Texts move
    once, into ranges of doc_id; a range also gets the first row of the range after it, so no row needs
    another task. Rows of one doc_id follow each other by the hash of their text; null ids come last; null
    text counts as empty; a single row is its own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("v", F.xxhash64("text"))
    total = d.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_chars))
    # ends of the ranges: one number per range, descending
    q = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    ends = sorted(set(q or []), reverse=True)
    bound = F.array(*[F.lit(x) for x in ends]) if ends else F.expr("cast(array() as array<bigint>)")
    # range 0 holds ids from the first end up; a null id counts as below all
    part = F.when(F.col("doc_id").isNull(), F.lit(len(ends))).otherwise(_below(bound, len(ends)))
    d = d.withColumn("part", part.cast("int"))
    heads = d.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("o"), "doc_id", (-F.col("v")).alias("v"))).alias("h"))
    heads = sorted((r["part"], r["h"]["doc_id"], r["h"]["v"]) for r in heads.collect())  # one row per range
    if not heads:
        return docs.select("doc_id", "text").limit(0).mapInArrow(lambda b: iter(()), _schema(docs))
    copies = spark.createDataFrame([(doc, -v, heads[i - 1][0]) for i, (_, doc, v) in enumerate(heads)], "hid bigint, hv bigint, before int")
    copies = copies.groupBy("hid", "hv").agg(F.collect_set("before").alias("before"))
    d = d.join(F.broadcast(copies), d["doc_id"].eqNullSafe(copies["hid"]) & (d["v"] == copies["hv"]), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    d = d.withColumn("to", F.explode(F.concat(F.array(own), F.coalesce(F.transform("before", lambda x: F.struct(x.alias("part"), F.lit(True).alias("tail"))), F.expr("cast(array() as array<struct<part:int,tail:boolean>>)")))))
    d = d.select(F.col("to.part").alias("part"), "doc_id", "text", F.col("to.tail").alias("tail"), "v")
    d = d.repartition(n, "part").sortWithinPartitions(F.col("part"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("v"))
    return d.select("part", "doc_id", "text", "tail").mapInArrow(_compare, _schema(docs))


def _below(bound, n: int):
    """How many of the descending ends lie above doc_id."""
    return F.size(F.filter(bound, lambda x: x > F.col("doc_id"))) if n else F.lit(0)


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
