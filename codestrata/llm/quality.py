"""Quality rules: plain text measures, and a calibrated logistic regression over hashed n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, texts, words

#: Labelled rows the model is fitted on at most (by hash of doc_id); a third of them calibrates.
SAMPLE = 6_144
#: Hash places of words and word pairs, and as many again of character n-grams.
PLACES = 1 << 15
GRAMS = (3, 4)
ROUNDS, RATE, DECAY = 60, 0.2, 1e-6
#: A text stays if its calibrated probability of good quality reaches this.
THRESHOLD = 0.3
#: Bytes hashed at a time, so that a very long text needs no more memory than this.
CHUNK = 1 << 20

MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(w: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text, the first one included."""
    grams = list(zip(*[w[i:] for i in range(WINDOW)]))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    n = end = 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            n += i + WINDOW - max(i, end)
            end = i + WINDOW
    return n


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    w = words(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in lines
            lines.add(line)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return len(w), len(text) - blanks, sum(map(text.count, SYMBOLS[1:-1])), dup, repeat_words(w)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PCT * n_words


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; words and characters each have length 1 together."""
    w = np.fromiter(map(zlib.crc32, words(text)), np.uint32, -1)
    pairs = (w[:-1] * np.uint32(2_654_435_761)) ^ w[1:]
    n_words = np.bincount(np.concatenate([w, pairs]) % PLACES, minlength=PLACES)
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    n_chars = np.zeros(PLACES, np.int64)
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK + max(GRAMS) - 1]
        for n in GRAMS:
            m = min(CHUNK, len(part) - n + 1)
            if m > 0:
                h = np.zeros(m, np.uint32)
                for i in range(n):
                    h = h * np.uint32(0x01000193) ^ part[i:i + m]
                n_chars += np.bincount((h * np.uint32(2_654_435_761)) >> np.uint32(17), minlength=PLACES)
    where, value = [], []
    for first, counts in ((0, n_words), (PLACES, n_chars)):
        at = np.flatnonzero(counts)
        v = counts[at].astype(np.float64)
        where.append(at + first)
        value.append(v / np.sqrt((v * v).sum()) if len(v) else v)
    return np.concatenate(where).astype(np.int32), np.concatenate(value).astype(np.float32)


@dataclass
class Model:
    """Weights of the places, bias, and the slope and shift that turn the margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, text: str) -> float:
        where, value = hashed(text)
        z = float(self.weights[where] @ value) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))


def fit_weights(where: list[np.ndarray], value: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with both classes weighing the same; full gradients, Adam steps."""
    row = np.repeat(np.arange(len(where)), [len(x) for x in where])
    at, v = np.concatenate(where), np.concatenate(value)
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, len(label) - label.sum()))
    w, bias = np.zeros(2 * PLACES), 0.0
    m, s = np.zeros(2 * PLACES + 1), np.zeros(2 * PLACES + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, v * w[at], len(label)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * share
        g = np.append(np.bincount(at, v * err[row], 2 * PLACES) + DECAY * w, err.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w.astype(np.float32), float(bias)


def calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the margin by Newton's method, towards Platt's smoothed targets."""
    good = label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        a += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounded sample in, one row with the model out."""
    rows = sorted(r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(4)]))
    where = [np.frombuffer(r[2], np.int32) for r in rows]
    value = [np.frombuffer(r[3], np.float32) for r in rows]
    label = np.array([r[1] for r in rows], np.float64)
    held = np.arange(len(rows)) % 3 == 2
    if not rows or len(set(label[~held])) < 2:  # nothing to tell apart: every text is good
        model = (np.zeros(2 * PLACES, np.float32), 0.0, 0.0, 30.0)
    else:
        w, bias = fit_weights([x for x, h in zip(where, held) if not h], [x for x, h in zip(value, held) if not h], label[~held])
        z = np.array([w[a] @ v for a, v in zip(where, value)]) + bias
        model = (w, bias, *(calibrate(z[held], label[held]) if len(set(label[held])) == 2 else (1.0, 0.0)))
    yield pa.RecordBatch.from_arrays([pa.array([model[0].tobytes()]), *[pa.array([float(x)]) for x in model[1:]]], ["weights", "bias", "slope", "shift"])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [hashed(t) for t in texts(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x, _ in f], pa.binary()), pa.array([x.tobytes() for _, x in f], pa.binary())], ["h", "label", "at", "value"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labelled rows: at most ``sample`` of them, the lowest by hash of doc_id.

    A document labelled more than once counts as good only if all its labels say so.
    """
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("bigint").alias("label"))
    some = some.withColumn("h", F.xxhash64(F.lit("quality"), "doc_id")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # ``sample`` ids at most
    rows = rows.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text")).select("h", "label", "text")
    rows = rows.mapInArrow(_hash_rows, "h bigint, label bigint, at binary, value binary")
    r = rows.repartition(1).mapInArrow(_train, "weights binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(r[0], np.float32), r[1], r[2], r[3]) if r else Model(np.zeros(2 * PLACES, np.float32), 0.0, 0.0, 30.0)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five measures, base_failed, quality (probability), kept, for every row.

    Null text counts as empty and fails the base rule; equal texts get equal verdicts; an empty table gives
    an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, p = [], []
            for t in texts(b.column(1)):
                m.append(measures(t))
                p.append(shared.value.probability(t))
            failed = [base_failed(x[0], x[4]) for x in m]
            cols = [pa.array([x[i] for x in m], pa.int64()) for i in range(5)]
            kept = [not f and q >= threshold for f, q in zip(failed, p)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(failed, pa.bool_()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())],
                                             ["doc_id", *BASE, "base_failed", "quality", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} bigint' for x in BASE)}, base_failed boolean, quality double, kept boolean")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text passes the base rule and the model, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            w = words(t)
            return not base_failed(len(w), repeat_words(w)) and shared.value.probability(t) >= threshold

        return pd.Series([one(t) for t in text], dtype=bool)

    return docs.where(good("text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))
