"""Quality by votes of near neighbours in a latent-semantic space.

A text is a bag of hashed terms of three kinds: words, byte trigrams, and trigrams of its outline (runs of small
letters, capitals, digits, each sign by itself), with a few terms that say how long and how repetitive it is.
Counts are damped and weighted by document frequencies over all documents. The leading directions of the
labelled sample's term matrix span the latent space; labelled vectors are broadcast, and every document
is compared with all of them in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, texts, words

#: Labelled rows learned from at most (by hash of doc_id): the vectors that are broadcast.
SAMPLE = 4_096
#: Hash places of words, byte trigrams and outline trigrams; places of the terms on length and repetition.
WORD_PLACES, GRAM_PLACES, OUTLINE_PLACES, STATED = 2048, 1024, 1024, 64
PLACES = WORD_PLACES + GRAM_PLACES + OUTLINE_PLACES + STATED
#: Dimensions of the latent space; rounds and spare directions of the search for them.
DIMS, ROUNDS, SPARE = 64, 4, 16
NEIGHBOURS, POWER = 15, 4.0
THRESHOLD = 0.5
#: Documents in a block; bytes hashed at a time, so that a very long text needs no more memory than this.
BLOCK, CHUNK = 128, 1 << 20

_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a"):ord("z") + 1] = ord("a")
_KIND[ord("A"):ord("Z") + 1] = ord("A")
_KIND[ord("0"):ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")


def _grams(data: np.ndarray, places: int) -> np.ndarray:
    """Counts of hashed trigrams of bytes."""
    out = np.zeros(places, np.int64)
    for at in range(0, len(data) - 2, CHUNK):
        part = data[at:at + CHUNK + 2].astype(np.uint32)
        h = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        out += np.bincount((h * np.uint32(2_654_435_761) >> np.uint32(12)) % np.uint32(places), minlength=places)
    return out


def terms(text: str) -> np.ndarray:
    """Counts of all ``PLACES`` terms of a text; one without words has none."""
    out = np.zeros(PLACES, np.int64)
    w = np.fromiter(map(zlib.crc32, words(text)), np.uint32, -1)
    n = len(w)
    if not n:
        return out
    out[:WORD_PLACES] = np.bincount(w % WORD_PLACES, minlength=WORD_PLACES)
    data = np.frombuffer(text.encode(), np.uint8)
    out[WORD_PLACES:WORD_PLACES + GRAM_PLACES] = _grams(data, GRAM_PLACES)
    kind = _KIND[data]
    kind = kind[np.concatenate([[True], kind[1:] != kind[:-1]])]
    out[WORD_PLACES + GRAM_PLACES:PLACES - STATED] = _grams(kind, OUTLINE_PLACES)
    lines = text.split("\n")
    shares = [len(np.unique(w)) / n, (w[1:] == w[:-1]).mean() if n > 1 else 0.0, len(set(lines)) / len(lines)]
    stated = [min(15, int(np.log2(n)))] + [16 * (i + 1) + min(15, int(16 * s)) for i, s in enumerate(shares)]
    out[PLACES - STATED:][stated] = 1
    return out


_KINDS = [slice(0, WORD_PLACES), slice(WORD_PLACES, WORD_PLACES + GRAM_PLACES), slice(WORD_PLACES + GRAM_PLACES, PLACES - STATED), slice(PLACES - STATED, PLACES)]


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as damped, weighted rows in which each kind of terms has length 1."""
    x = (np.log1p(counts) * idf).astype(np.float32)
    for k in _KINDS:
        x[:, k] /= np.maximum(np.sqrt((x[:, k] ** 2).sum(axis=1, keepdims=True)), 1e-12)
    return x


def directions(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(terms, dims): the leading right singular vectors of ``x``, by subspace iteration from a fixed start."""
    k = min(dims + SPARE, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], k)).astype(np.float32)
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :dims], np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Model:
    """idf of all places, the latent directions, the labelled unit vectors and their labels, the share of good ones."""

    idf: np.ndarray
    basis: np.ndarray
    known: np.ndarray
    label: np.ndarray
    share: float

    def scores(self, block: list[str]) -> np.ndarray:
        """Votes for a block of texts: labels of the nearest vectors, each weighing its cosine to a power.

        A text without words scores 0; one that resembles no labelled text the share of good labels.
        """
        counts = np.stack([terms(t) for t in block])
        out = np.full(len(block), self.share)
        if len(self.known):
            cosine = _unit(weighed(counts, self.idf) @ self.basis) @ self.known.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0.0) ** POWER
            total = weight.sum(axis=1)
            out = np.where(total > 1e-9, (weight * self.label[near]).sum(axis=1) / np.maximum(total, 1e-9), out)
        out[counts.sum(axis=1) == 0] = 0.0
        return np.clip(out, 0.0, 1.0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in; per task, in how many of them each place occurs, and how many there are (place -1)."""
    seen, n = np.zeros(PLACES, np.int64), 0
    for b in batches:
        for t in texts(b.column(0)):
            seen += terms(t) > 0
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, PLACES)), pa.array(np.concatenate([[n], seen]))], ["place", "n"])


def idf(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + documents with the term)) of every place, over all documents."""
    found = docs.select("text").mapInArrow(_frequencies, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    counts = {r[0]: r[1] for r in found.collect()}  # PLACES + 1 rows
    seen = np.array([counts.get(i, 0) for i in range(PLACES)], np.float64)
    return np.log((1.0 + counts.get(-1, 0)) / (1.0 + seen)).astype(np.float32)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, label, text) in; the counts of the text's terms out."""
    for b in batches:
        c = [terms(t) for t in texts(b.column(2))]
        at = [np.flatnonzero(x) for x in c]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()),
                                          pa.array([x[a].astype(np.int32).tobytes() for x, a in zip(c, at)], pa.binary())], ["h", "label", "at", "n"])


def _learn(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bounded sample in, one row with directions, vectors and labels out."""
        rows = sorted((r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(4)])), key=lambda r: r[0])
        if not rows:
            return
        x = np.zeros((len(rows), PLACES), np.float32)
        for at in range(0, len(rows), BLOCK):
            some = np.zeros((min(BLOCK, len(rows) - at), PLACES), np.int64)
            for i, r in enumerate(rows[at:at + BLOCK]):
                some[i, np.frombuffer(r[2], np.int32)] = np.frombuffer(r[3], np.int32)
            x[at:at + BLOCK] = weighed(some, weights)
        basis = directions(x)
        known = _unit(x @ basis).astype(np.float32)
        label = np.array([r[1] for r in rows], np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (basis, known, label)], ["basis", "known", "label"])

    return run


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learned from at most ``sample`` labelled rows that are not held out, the lowest by hash of doc_id.

    A document labelled more than once counts as good only if all its labels say so; of several texts under
    one id the least one counts. Document frequencies are those of all documents.
    """
    weights = idf(docs)
    some = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    some = some.withColumn("h", F.xxhash64(F.lit("neighbours"), "doc_id")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # ``sample`` ids at most
    rows = rows.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text")).select("h", "label", "text")
    rows = rows.mapInArrow(_sparse, "h bigint, label int, at binary, n binary")
    r = rows.repartition(1).mapInArrow(_learn(weights), "basis binary, known binary, label binary").first()
    if r is None:
        return Model(weights, np.zeros((PLACES, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 0.0)
    basis, label = np.frombuffer(r[0], np.float32).reshape(PLACES, -1), np.frombuffer(r[2], np.float32)
    return Model(weights, basis, np.frombuffer(r[1], np.float32).reshape(len(label), -1), label, float(label.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Null text counts as empty; texts without words score 0; very long texts are hashed piece by piece; equal
    texts score alike; without labelled rows texts score 0; an empty table gives an empty result; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PLACES + SAMPLE rows of DIMS numbers: 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(list(texts(part.column(1)))), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op12_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
