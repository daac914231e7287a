"""Hard negatives by branch and bound over columns (BOND): dimensions are read one after the other, bounds prune rows.

Rows lie in blocks, every dimension of a block as one column, rows of a label side by side. For an anchor the
dimensions are read in descending magnitude of its own components. After each few of them a row's score lies
between its partial score plus the least and plus the most that the remaining dimensions can add, by the
minima and maxima of the columns. Rows that can no longer be among the best of their window leave the
candidates; those that remain get exact scores. Blocks of rows are met by blocks of anchors in one sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table, written

#: Rows of a block, anchors of a block; a pair of blocks is what one step of a task holds.
BLOCK, ANCHORS = 8192, 512
#: Dimensions read between two looks at the bounds.
STRIDE = 8
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
SCALE = 256


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec): rows that take part, components scaled and floored to whole numbers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    vec = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))
    return d.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), vec.alias("vec"))


_BLOCK = "block int, n int, dims int, ids binary, labels binary, cols binary"


def _matrix(vecs: pa.Array, dims: int) -> np.ndarray:
    """Rows by dimensions; shorter vectors are filled up with zeros."""
    lengths = np.diff(vecs.offsets.to_numpy())
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = vecs.flatten().to_numpy()
    return out


def _pack(size: int):
    """Rows (vec_id, label, vec) of a partition as blocks of at most ``size`` rows, sorted by label, in columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[pa.Table] = []

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
            vecs = t["vec"].combine_chunks()
            vecs = vecs.chunk(0) if isinstance(vecs, pa.ChunkedArray) else vecs
            dims = int(np.diff(vecs.offsets.to_numpy()).max(initial=0))
            cols = np.ascontiguousarray(_matrix(vecs, dims).T)
            values = [number, t.num_rows, dims, t["vec_id"].to_numpy().astype(np.int64).tobytes(), t["label"].to_numpy().astype(np.int64).tobytes(), cols.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                              ["block", "n", "dims", "ids", "labels", "cols"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            while sum(t.num_rows for t in held) >= size:
                t = pa.concat_tables(held)
                yield block(t.slice(0, size))
                held = [t.slice(size)]
        if sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held))

    return run


class Block:
    """Columns of a block in a type in which every score is exact, and their bounds."""

    def __init__(self, n: int, dims: int, ids: bytes, labels: bytes, cols: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = np.frombuffer(cols, np.int64).reshape(dims, n)
        self.cols = {np.dtype(np.int64): self.whole}
        self.low, self.high = self.whole.min(axis=1), self.whole.max(axis=1)

    def fitted(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and columns: as single precision where all sums stay below 2**24, as 64-bit integers elsewhere."""
        most = float((np.abs(anchor.astype(np.float64)) * np.maximum(np.abs(self.low.astype(np.float64)), np.abs(self.high.astype(np.float64)))).sum())
        kind = np.dtype(np.float32 if most < 1 << 24 else np.int64)
        if kind not in self.cols:
            self.cols[kind] = self.whole.astype(kind)
        return anchor.astype(kind), self.cols[kind]


def scan(block: Block, anchor: np.ndarray, spans: list[tuple[int, int]], prune) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the rows in ``spans`` that ``prune(least, most)`` never drops.

    ``prune`` gets the least and the greatest score that every candidate can still reach and returns which
    of them stay.
    """
    dims = min(len(anchor), len(block.whole))
    anchor, cols = block.fitted(np.concatenate([anchor, np.zeros(max(0, len(block.whole) - len(anchor)), np.int64)])[:len(block.whole)])
    order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
    a, b = anchor * block.low.astype(anchor.dtype), anchor * block.high.astype(anchor.dtype)
    least, most = np.minimum(a, b)[order], np.maximum(a, b)[order]
    least, most = least[::-1].cumsum()[::-1], most[::-1].cumsum()[::-1]  # what dimensions from here on add
    whole = len(spans) == 1 and spans[0][1] - spans[0][0]
    rows = np.concatenate([np.arange(lo, hi) for lo, hi in spans]) if spans else np.zeros(0, np.int64)
    part = np.zeros(len(rows), anchor.dtype)
    for at in range(0, dims, STRIDE):
        some = order[at:at + STRIDE]
        if whole and len(rows) == whole:  # none has left: columns are read in place
            lo, hi = spans[0]
            for d in some:
                part += cols[d, lo:hi] * anchor[d]
        else:
            for d in some:
                part += cols[d].take(rows) * anchor[d]
        end = at + STRIDE
        if end < dims:
            stay = prune(part + least[end], part + most[end])
            if not stay.all():
                rows, part = rows[stay], part[stay]
                if not len(rows):
                    break
    return rows, part.astype(np.int64)


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else None


def positives(block: Block, anchor: np.ndarray, own: int, label: int, k: int = POSITIVES) -> list[tuple[int, int]]:
    """(score, vec_id) of the block's best ``k`` rows of the anchor's label, other than its own."""
    lo, hi = np.searchsorted(block.labels, [label, label + 1])
    inside = block.ids[lo:hi]
    spans, at = [], lo
    for i in np.flatnonzero(inside == own):  # ids are in order within a label
        spans.append((at, lo + i))
        at = lo + i + 1
    spans = [s for s in [*spans, (at, hi)] if s[0] < s[1]]

    def prune(least, most):
        edge = _kth(least, k)
        return np.ones(len(least), bool) if edge is None else most >= edge

    rows, score = scan(block, anchor, spans, prune)
    best = np.lexsort((block.ids[rows], -score))[:k]
    return [(int(score[i]), int(block.ids[rows[i]])) for i in best]


def windows(scores: list[int]) -> list[tuple[int, int]]:
    """Least and greatest negative score for each positive score."""
    return [(-(-LOW * s // 100), HIGH * s // 100) for s in scores]


def negatives(block: Block, anchor: np.ndarray, own: int, label: int, scores: list[int], k: int = NEGATIVES) -> list[list[tuple[int, int]]]:
    """For every positive score, (score, vec_id) of the block's best ``k`` rows of other labels in its window."""
    edges = windows(scores)
    wide = sorted({e for e in edges if e[0] <= e[1]})
    if not wide:
        return [[] for _ in scores]
    lo, hi = np.searchsorted(block.labels, [label, label + 1])
    spans = [s for s in ((0, lo), (hi, len(block.labels))) if s[0] < s[1]]
    sure_rows = k + np.count_nonzero(block.ids == own)  # the anchor's own rows go below, so they are no winners

    def prune(least, most):
        stay = np.zeros(len(least), bool)
        for low, high in wide:
            sure = least[(least >= low) & (most <= high)]  # in the window whatever comes
            edge = _kth(sure, sure_rows)
            stay |= (most >= (low if edge is None else edge)) & (least <= high)
        return stay

    rows, score = scan(block, anchor, spans, prune)
    mine = block.ids[rows] != own
    rows, score = rows[mine], score[mine]
    order = np.lexsort((block.ids[rows], -score))
    rows, score = rows[order], score[order]
    out = []
    for low, high in edges:
        found = np.flatnonzero((score >= low) & (score <= high))[:k] if low <= high else []
        out.append([(int(score[i]), int(block.ids[rows[i]])) for i in found])
    return out


def _anchors(b: pa.RecordBatch, i: int) -> Iterator[tuple]:
    """(number, vec_id, label, vec, positive scores) of the anchor block in row ``i``."""
    for a in b.column(6)[i]:
        a = a.as_py()
        yield a["anchor"], a["vec_id"], a["label"], np.array(a["vec"], np.int64), a.get("scores")


def _scan(find, names: list[str]):
    """Rows (block, n, dims, ids, labels, cols, anchors) in, those of a block together and its columns first; rows of ``find(block, anchor)`` out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != number:
                    number, held = b.column(0)[i].as_py(), []
                if b.column(5)[i].is_valid:
                    held.append(Block(*[b.column(j)[i].as_py() for j in range(1, 6)]))
                    continue
                rows = [r for a in _anchors(b, i) for block in held for r in find(block, *a)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(names))], names)

    return run


def _meet(blocks: DataFrame, anchors: DataFrame, n_blocks: int, find, names: list[str]) -> DataFrame:
    """``find`` for every anchor in every block; anchors travel in blocks of ``ANCHORS``.

    Each block goes to a task once, and the anchors follow it there by a plain shuffle. A join would take the lists
    for as small as they are before they are copied to all blocks, and send the copies through the driver.
    """
    dealt = anchors.withColumn("a", F.floor(F.col("anchor") / ANCHORS))
    lists = dealt.groupBy("a").agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    lists = lists.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "a", "anchors")
    d = blocks.withColumn("a", F.lit(-1)).unionByName(lists, allowMissingColumns=True)
    d = d.repartition(n_blocks, "block").sortWithinPartitions("block", "a")
    return d.select("block", "n", "dims", "ids", "labels", "cols", "anchors").mapInArrow(_scan(find, names), ", ".join(f"{c} bigint" for c in names))


def _best(d: DataFrame, keys: list[str], k: int, score: str, tie: str) -> DataFrame:
    """The first ``k`` of every key; tasks cut to ``k`` before they shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), tie))
    return d.withColumn("rank", place).where(F.col("rank") <= k)


def _numbered(anchors: DataFrame) -> DataFrame:
    """Anchors (vec_id, label, vec) with gapless numbers, so that blocks of anchors are full and bounded."""
    part = written(anchors.withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
    counts = part.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = counts.select("p", "first", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return part.join(F.broadcast(before), "p").select((F.col("base") + F.col("m") - F.col("first")).alias("anchor"), "vec_id", "label", "vec")


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are (vec_id, label, vec) as ``usable`` gives them, ``is_anchor`` says which of them are anchors.
    Ties go by the smaller vec_id. Vectors of different lengths are compared as if filled up with zeros. Rows
    under an anchor's own vec_id never are its partners; equal rows elsewhere are as many partners; an
    anchor that stands in several equal rows counts once. An anchor without positives, a positive without
    negatives and an empty table give no rows. Products must stay within 64-bit integers.
    """
    spark = rows.sparkSession
    n_blocks = max(1, -(-rows.count() // BLOCK))
    blocks = written(rows.repartition(n_blocks).mapInArrow(_pack(BLOCK), _BLOCK))
    anchors = written(_numbered(rows.where(is_anchor).distinct()))

    def near(block, anchor, own, label, vec, _):
        return [(anchor, own, p, s) for s, p in positives(block, vec, own, label)]

    found = _meet(blocks, anchors, n_blocks, near, ["anchor", "anchor_id", "positive_id", "positive_score"])
    best = written(_best(found, ["anchor"], POSITIVES, "positive_score", "positive_id").withColumnRenamed("rank", "p"))
    scores = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("p", "positive_score"))).alias("s"))  # POSITIVES at most
    asked = anchors.join(scores.hint("merge"), "anchor").select("anchor", "vec_id", "label", "vec", F.col("s.positive_score").alias("scores"))

    def hard(block, anchor, own, label, vec, scores):
        return [(anchor, i + 1, q, s) for i, out in enumerate(negatives(block, vec, own, label, scores)) for s, q in out]

    pairs = _meet(blocks, asked, n_blocks, hard, ["anchor", "p", "negative_id", "negative_score"])
    pairs = _best(pairs, ["anchor", "p"], NEGATIVES, "negative_score", "negative_id")
    d = pairs.join(best.hint("merge"), ["anchor", "p"])  # small on disk is not small in memory: no broadcast
    return d.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = usable(table(spark, sf_dir, "embeddings"))
    d = d.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return mine(d, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (((label + 1) % 10) + 10) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), TRUE)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             CAST(coalesce(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
      FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""
