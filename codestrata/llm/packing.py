"""Packing by length: bucket boundaries of least padding, token-budget batches inside each bucket."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import cells, running, table

MAX_LEN = 2_048
BUCKETS = 16
BATCH_TOKENS = 65_536

#: A word; the length of a text is its words. Any other count, such as a tokenizer's, can be passed in as a column.
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` padded lengths that minimise the padding of this histogram.

    Dynamic programming over the distinct lengths: best[k][j] is the least padding of the lengths up to
    the j-th in k buckets, the last of which ends there. Ties take the longer last bucket.
    """
    if not len(lengths):
        return []
    order = np.argsort(lengths)
    size = np.asarray(lengths, np.int64)[order]
    n = np.asarray(counts, np.int64)[order]
    rows = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[0], np.cumsum(n * size)])
    best = np.concatenate([[0], size * rows[1:] - total[1:]])  # one bucket
    back = []
    for _ in range(1, min(buckets, len(size))):
        now, frm = best.copy(), np.zeros(len(best), np.int64)
        for j in range(1, len(best)):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (total[j] - total[:j])
            frm[j] = np.argmin(cost)
            now[j] = cost[frm[j]]
        best = now
        back.append(frm)
    out, j = [], len(size)
    for frm in reversed(back):
        out.append(int(size[j - 1]))
        j = int(frm[j])
        if not j:
            break
    if j:
        out.append(int(size[j - 1]))
    return sorted(out)


def pack(docs: DataFrame, length: Column | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS,
         batch_tokens: int = BATCH_TOKENS, order: Sequence[Column] | None = None, cell: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, padded_len, batch, slot.

    A text longer than ``max_len`` tokens is cut into pieces of that length, so the histogram the
    boundaries are planned on has at most ``max_len`` + 1 rows however many documents there are. Inside a
    bucket, pieces follow ``order`` (hash order if none is given) and every batch takes as many as fit into
    ``batch_tokens`` when padded, one at least. ``order`` may come with ``cell``, a coarser value that
    never falls along it and splits the rows into small parts. Empty and null texts are one piece of no
    tokens; equal rows take neighbouring slots; an empty table gives an empty result; other columns are
    not read.
    """
    length = F.regexp_count("text", F.lit(WORD)) if length is None else length
    order = list(order or [])
    d = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("bigint").alias("all"), *[c.alias(f"o{i}") for i, c in enumerate(order)],
                    *([cell.alias("c")] if cell is not None else []))
    d = d.withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(0L, (all - 1) div {max_len}))")))
    d = cut_lineage(d.withColumn("start", F.col("piece") * max_len).withColumn("n_tokens", F.least(F.lit(max_len), F.col("all") - F.col("start"))))
    hist = d.groupBy("n_tokens").count().collect()  # max_len + 1 rows at most
    bounds = boundaries([r[0] for r in hist], [r[1] for r in hist], buckets) or [max_len]
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    d = d.withColumn("bucket", bucket).withColumn("padded_len", F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1))
    d = d.withColumn("h", F.xxhash64(F.lit("pack"), "doc_id", "piece"))
    if cell is None:
        m = cells(d)
        d = d.withColumn("c", F.pmod("h", F.lit(m)) if not order else F.lit(0))
    d = running(d, ["bucket"], "c", [*[f"o{i}" for i in range(len(order))], "h", "doc_id", "piece"], F.lit(1), "rank")
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("padded_len"))))
    return d.select("doc_id", "piece", "start", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "padded_len",
                    F.floor(F.col("rank") / each).alias("batch"), (F.col("rank") % each).cast("int").alias("slot"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


#: Rows of a file that one task orders at a time when files are read back in their order.
FILE_ROWS = 4_096


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches that take the documents in the order in which their files hold them: the mixing order."""
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    part = F.coalesce(F.expr("try_cast(nullif(regexp_extract(_metadata.file_name, 'part-([0-9]+)'), '') as bigint)"), F.lit(0))
    try:
        docs.select(name, row)
    except AnalysisException:  # not read from files: hash order
        return pack(docs)
    return pack(docs, order=[part, name, row], cell=F.struct(part.alias("p"), name.alias("f"), F.expr(f"_metadata.row_index div {FILE_ROWS}").alias("r")))
