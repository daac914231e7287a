"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features: densities of two lexicon tiers, their hits near second-person words, capitals, punctuation and
obfuscation rates. The lexicon is a short fixed list and the word beginnings that training rows labelled
toxic use far more often than the others. Lexicon, trees and calibration are learned from three disjoint
parts of the training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import table, texts

#: Labelled rows learned from at most (by hash of doc_id): two fifths for the lexicon, two for the trees, one for calibration.
SAMPLE = 20_000
TREES, DEPTH = 20, 4
#: Learned word beginnings kept at most, in each tier.
LEXICON = 2_000
STRONG, MILD, LEAST = 25.0, 6.0, 3
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Words between a lexicon hit and a second-person word that still count as near.
NEAR = 5
#: Known words remembered by a task; the store starts anew when it is full.
MEMORY = 200_000

INSULTS = frozenset("idiot moron loser scum stupid worthless pathetic trash disgusting clown dumb fool jerk creep garbage vermin filth imbecile cretin".split())
SECOND = frozenset("you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tuyo vosotros".split())
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")
_PLAIN = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
FEATURES = ["strong", "mild", "strong_log", "near_second", "second", "capitals", "capital_words", "exclaims", "questions", "punctuation", "obfuscated", "hidden_hits", "words_log"]
_SECOND, _CAPITAL, _OBFUSCATED, _HIDDEN, _STRONG, _MILD = 1, 2, 4, 8, 16, 32


@dataclass
class Lexicon:
    strong: frozenset[str] = INSULTS
    mild: frozenset[str] = frozenset()
    _memory: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.strong, self.mild

    def __setstate__(self, state):
        self.strong, self.mild = state
        self._memory = {}

    def tier(self, word: str) -> int:
        stems = [word, *[word[:n] for n in STEMS if len(word) >= n]]
        if not self.strong.isdisjoint(stems):
            return _STRONG
        return _MILD if not self.mild.isdisjoint(stems) else 0

    def marks(self, raw: str) -> int:
        found = self._memory.get(raw)
        if found is None:
            if len(self._memory) >= MEMORY:
                self._memory.clear()
            core = _ENDS.sub("", raw)
            low = core.lower()
            found = (_SECOND if low in SECOND else 0) | (_CAPITAL if len(core) > 1 and core.isupper() else 0)
            if not core or _PLAIN.fullmatch(core):
                found |= self.tier(low)
            else:  # letters mixed with digits or signs
                mixed = any(map(str.isalpha, core))
                clear = "".join(_PLAIN.findall(low.translate(LOOK_ALIKE)))
                t = self.tier(clear)
                found |= t | (_OBFUSCATED if mixed else 0) | (_HIDDEN if t and mixed else 0)
            self._memory[raw] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The values of ``FEATURES`` for one text; an empty one has all zeros."""
    ws = text.split()
    n, chars = len(ws), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    m = np.fromiter(map(lexicon.marks, ws), np.uint8, n)
    count = [int(np.count_nonzero(m & bit)) for bit in (_SECOND, _CAPITAL, _OBFUSCATED, _HIDDEN, _STRONG, _MILD)]
    near = 0
    if count[0] and count[4] + count[5]:
        hits, second = np.flatnonzero(m & (_STRONG | _MILD)), np.flatnonzero(m & _SECOND)
        right = np.minimum(np.searchsorted(second, hits), len(second) - 1)
        left = np.maximum(right - 1, 0)
        near = int((np.minimum(abs(second[right] - hits), abs(hits - second[left])) <= NEAR).sum())
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(data, minlength=128)
    signs = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    return [count[4] / n, count[5] / n, float(np.log1p(count[4])), near / n, count[0] / n, int(kinds[65:91].sum()) / chars, count[1] / n,
            int(kinds[33]) / n, int(kinds[63]) / n, signs / chars, count[2] / n, count[3] / n, float(np.log1p(n))]


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for b in batches:
        for t, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
            found = {w[:n] for w in set(_PLAIN.findall(t.lower())) for n in STEMS if len(w) >= n}
            (toxic if y else clean).update(found)
    stems = sorted({*toxic, *clean})
    yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([toxic[s] for s in stems], pa.int64()), pa.array([clean[s] for s in stems], pa.int64())], ["stem", "toxic", "clean"])


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From (text, label): stems by how many times likelier a toxic text is to use them, ``LEXICON`` a tier at most."""
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    odds = (F.col("toxic") / n[1]) / ((F.col("clean") + 0.5) / n[0])
    found = rows.select("text", "label").mapInArrow(_stems, "stem string, toxic bigint, clean bigint").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = found.where(F.col("toxic") >= max(LEAST, n[1] // 100)).withColumn("odds", odds).where(F.col("odds") >= MILD)
    best = found.orderBy(F.desc("odds"), "stem").limit(2 * LEXICON).collect()
    strong = [r["stem"] for r in best if r["odds"] >= STRONG][:LEXICON]
    return Lexicon(INSULTS | frozenset(strong), frozenset([r["stem"] for r in best if r["odds"] < STRONG][:LEXICON]))


def with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and ``dense``: the features of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t, lexicon) for t in texts(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(f, pa.list_(pa.float64()))], [*keep, "dense"])

    d = docs.select(*keep, "text")
    return d.mapInArrow(run, ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in keep) + ", dense array<double>")


@dataclass
class Model:
    """Without trees (no two classes to learn from) every score is ``share``, the part of toxic labels."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    share: float


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learned from at most ``sample`` labelled rows that are not held out; of several labels the highest counts."""
    some = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    some = some.withColumn("h", F.xxhash64(F.lit("toxic"), "doc_id")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # ``sample`` ids at most
    rows = rows.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text"))
    rows = cut_lineage(rows.select("label", F.pmod("h", F.lit(5)).alias("part"), "text"))
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    lexicon = learn_lexicon(rows.where("part < 2"))
    learn = cut_lineage(with_features(rows.where("part >= 2"), lexicon, ["label", "part"])).withColumn("features", array_to_vector("dense"))
    tree_rows = learn.where("part < 4")
    if tree_rows.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, share)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, labelCol="label").fit(tree_rows)
    rest = _raw(trees, learn.where("part = 4"))
    if rest.select("label").distinct().count() < 2:
        return Model(lexicon, trees, None, share)
    return Model(lexicon, trees, IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(rest), share)


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Null text counts as empty, and empty texts have a score like any other; equal texts score alike; an
    empty table gives an empty result; other columns are not read.
    """
    if model.trees is None:
        return docs.select("doc_id", F.lit(float(model.share)).alias("score"))
    d = with_features(docs, model.lexicon, ["doc_id"]).withColumn("features", array_to_vector("dense"))
    d = _raw(model.trees, d)
    d = model.steps.transform(d) if model.steps else d.withColumn("score", F.col("raw"))
    return d.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
