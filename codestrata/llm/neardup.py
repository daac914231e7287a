"""Near-dedup on word shingles: SimHash chains and MinHash bands give candidates, the exact Jaccard likeness decides.

Fingerprints of the shingles meet under the chain keys of ``simhash.links`` and are linked within 3 bits. Sixty-four
bits alone cannot serve a likeness of 0.8: such pairs differ in some ten bits, and keys that allow for
ten are too short to tell strangers apart. So bands of minima give further candidates. A band of ``ROWS`` minima is shared with probability J ** ROWS;
at least one of ``BANDS`` is shared with 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996 where J is just 0.8.

Sets under one key are first held against one of them, the lead, so that most links cost work by members and not by
pairs. The first lead of a key is the set that shares most with others; where some set is unlike the lead, the
key is made finer by two more minima, and the sets under each finer key meet another lead, chosen among
those that none was like so far, for ``LEVELS`` rounds.

Then all other pairs have their turn: under every key whose sets are not linked yet, sets of different groups meet
in blocks of bounded size. Parities (``odd``) tell at least in how many values two sets differ, so they rule
pairs out without a loss; the sets of those that remain are compared in full. So the groups are those that all pairs give
which share a band key or are within 3 bits, whatever leads there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import simhash
from .common import components, merged, texts, written

#: Words in a shingle; the least likeness in percent; bands and minima in a band.
WIDTH, LEAST, BANDS, ROWS = 5, 80, 20, 5
#: Leads that a set meets under one key at most; minima that make a key finer.
LEVELS, FINER = 5, 2
#: Sets in a block, and their values together, where sets meet that no lead has linked.
BLOCK, VOLUME = 512, 1 << 20
#: Values hashed at a time; bounds the memory for a very long text.
VALUES = 1 << 18
_MIX = np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.random.default_rng(12).integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words in lower case; a shorter text is one shingle, no words none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    last = ends[width - 1:].tolist() if len(w) >= width else [len(line)]
    first = [0, *(ends[:len(last) - 1] + 1).tolist()]
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(line[a:b]) for a, b in zip(first, last)), np.uint64, len(last)))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of a set under each of ``BANDS`` * ``ROWS`` hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, VALUES // (BANDS * ROWS))
    for at in range(0, len(s), step):
        r = (s[at:at + step, None] ^ _MIX[0]) * _MIX[1]
        r ^= r >> np.uint64(32)
        least = np.minimum(least, r.min(axis=0))
    return least


def _folded(least: np.ndarray, rows: int) -> np.ndarray:
    """The first ``rows`` minima of every band as one number."""
    key = (least.reshape(BANDS, ROWS)[:, :rows] * _FOLD[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands, and what makes them finer; an empty set has no keys."""
    if not len(s):
        return (np.zeros(0, np.int64),) * 2
    least = minima(s)
    return _folded(least, ROWS), _folded(least, FINER)


def odd(s: np.ndarray) -> bytes:
    """One bit for each of some 4 to 8 buckets a value: whether it holds an odd number of values.

    Values that two sets share change the same bit in both, so sets differ in at least as many values as their bits.
    """
    n = max(64, 1 << int(4 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1, bitorder="little").tobytes()


def _halved(m: np.ndarray) -> np.ndarray:
    """Parities of half as many buckets, from the last axis."""
    h = m.shape[-1] // 2
    return m[..., :h] ^ m[..., h:]


def possible(n: int, x: np.ndarray, ns: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which sets of ``ns`` values and parities ``ys`` can be alike to one of ``n`` values and parities ``x``."""
    if not x.shape[-1] <= 2 * ys.shape[-1] <= 4 * x.shape[-1]:  # alike sets are of nearly one size
        return np.zeros(len(ns), bool)
    if x.shape[-1] > ys.shape[-1]:
        x = _halved(x)
    elif x.shape[-1] < ys.shape[-1]:
        ys = _halved(ys)
    apart = np.maximum(np.bitwise_count(x ^ ys).sum(axis=-1, dtype=np.int64), np.abs(ns - n))
    return (100 + LEAST) * apart <= (100 - LEAST) * (n + ns)


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in texts(b.column(2))]
        ids = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
        signed = [pa.array(x, pa.list_(pa.int64())) for x in zip(*map(signature, sets))] if sets else [pa.array([], pa.list_(pa.int64()))] * 2
        signed += [pa.array([len(x) for x in sets], pa.int64()), pa.array(map(odd, sets), pa.binary())]
        fp = np.fromiter((simhash.fingerprint(t, WIDTH) for t in texts(b.column(2))), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids), *signed, pa.array(fp)], ["doc_id", "v", "sid", "bands", "finer", "n", "odd", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = [shingles(t) for t in texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))], ["sid", "s"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        stay = [bool(possible(x, np.frombuffer(p.as_buffer(), np.uint64), nb[i:i + 1], np.frombuffer(q.as_buffer(), np.uint64)[None])[0])
                for i, (x, p, q) in enumerate(zip(na, b.column(4), b.column(5)))]
        yield b.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))


def _confirmed(pairs: DataFrame, one: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) whose sets are at least ``LEAST`` percent alike; parities keep strangers from being compared."""
    marks = one.select("sid", "n", "odd")
    d = merged(merged(pairs, marks.toDF("a", "na", "ka"), "a"), marks.toDF("b", "nb", "kb"), "b")
    d = d.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_possible, "a bigint, b bigint")
    d = merged(merged(d, sets.toDF("a", "sa"), "a"), sets.toDF("b", "sb"), "b")
    d = d.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return d.where(100 * F.col("both") >= LEAST * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _shared(keys: DataFrame, *what: Column) -> DataFrame:
    """Rows whose key stands in several rows, with ``n`` and the aggregates ``what`` of the key.

    The aggregate is written before it is joined: a hot key's rows then come by a plain shuffle, which can be split.
    """
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n"), *what).where("n > 1"))
    return merged(keys, counts, "key")


def _near(marks: DataFrame) -> DataFrame:
    """(a, b): candidates whose fingerprints are within 3 bits, from (sid, fp). Of equal fingerprints one set is the lead.

    Leads are written before they are joined, so that a very common fingerprint can be split.
    """
    leads = written(marks.groupBy("fp").agg(F.min("sid").alias("lead")))
    equal = merged(marks, leads, "fp").where("sid <> lead").select(*_pairs("sid", "lead"))
    a, b = leads.toDF("a", "la"), leads.toDF("b", "lb")
    close = merged(merged(simhash.links(leads.select("fp")), a, "a"), b, "b").where("la <> lb").select(*_pairs("la", "lb"))
    return written(equal.union(close).distinct())


def _roots(one: DataFrame, marks: DataFrame, sets) -> DataFrame:
    """(node, root) of the sets that have links. ``one``: sid, bands, finer, n, odd; ``marks``: sid, fp; ``sets(sids)``: the sets of some."""
    near = _near(marks)
    keys = one.select("sid", F.posexplode("bands").alias("band", "key"))
    state = written(_shared(keys))
    crowd = state.groupBy("sid").agg(F.sum("n").alias("crowd"))
    close = near.select(F.col("a").alias("sid")).union(near.select("b")).distinct()
    sets = written(sets(crowd.select("sid").union(close).distinct()))
    state = merged(state.drop("n"), crowd, "sid").withColumn("apart", F.lit(True))
    links = written(_confirmed(near, one, sets))
    for level in range(LEVELS):
        state = written(state)
        if level and state.isEmpty():
            break
        # the lead: first the set with most company, then any of those that were unlike all leads so far
        order = F.struct("crowd", "sid") if level == 0 else F.struct(F.xxhash64("sid", "band", F.lit(level)), F.col("sid"))
        leads = written(state.where("apart").groupBy("key").agg(F.max_by("sid", order).alias("lead")))
        met = written(merged(state, leads, "key").where("sid <> lead"))
        others = others if level else met.select("key", "sid")  # all that the first lead has met
        new = written(_confirmed(met.select(*_pairs("sid", "lead")).distinct(), one, sets))
        links = links.union(new)
        if level + 1 == LEVELS:
            break
        alike = new.select(F.col("a").alias("sid"), F.col("b").alias("lead")).union(new.select("b", "a")).withColumn("alike", F.lit(True))
        rest = merged(met, alike, ["sid", "lead"], "left").withColumn("apart", F.col("apart") & F.col("alike").isNull())
        finer = F.element_at("finer", F.pmod(F.col("band") + F.lit(level + 1), F.lit(BANDS)) + 1)
        open_ = written(rest.groupBy("key").agg(F.max("apart").alias("open")).where("open")).select("key")
        rest = merged(merged(rest, open_, "key", "left_semi"), one.select("sid", "finer"), "sid")
        rest = written(rest.select("sid", "band", F.xxhash64("key", finer).alias("key"), "crowd", "apart"))
        state = _shared(rest, F.max("apart").alias("open")).where("open").drop("n", "open")
    root = written(components(links))
    chains = merged(marks, close, "sid", "left_semi").select("sid", "fp", F.explode(simhash.chain_keys(F.col("fp"))).alias("key"))
    others = others.select("key", "sid", F.lit(0).cast("bigint").alias("fp"), F.lit(False).alias("near"))
    rest = written(_rest(others.unionByName(chains.withColumn("near", F.lit(True))), one, root, sets))
    if rest.isEmpty():
        return root
    wider = written(components(rest))
    moved = merged(root, wider.toDF("root", "least"), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return moved.union(merged(wider, root, "node", "left_anti"))


def _rest(rows: DataFrame, one: DataFrame, root: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): roots that some pair links whose sets share a key, from (key, sid, fp, near) and the roots known so far.

    A key's sets of different roots meet in blocks. The most common root of a large key only meets the others, so rows
    stay in proportion where nearly all sets are linked. Lists of blocks carry parities; sets follow only for those that
    can still be alike to one of another root.
    """
    d = merged(rows, root.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    d = merged(d, one.select("sid", "n"), "sid")
    by = ["near", "key"]
    counts = d.groupBy(*by, "root").agg(F.count("*").alias("c"), F.sum("n").alias("v"))
    counts = counts.groupBy(*by).agg(F.count("*").alias("roots"), F.sum("c").alias("c"), F.sum("v").alias("v"),
                                     F.max_by(F.struct("root", "c", "v"), F.struct("v", "root")).alias("top")).where("roots > 1")

    def blocks(c: Column, v: Column) -> Column:
        return F.greatest(F.ceil(c / BLOCK), F.ceil(v / VOLUME))

    large = blocks(F.col("c"), F.col("v")) > 1
    counts = written(counts.select(*by, F.when(large, blocks(F.col("c") - F.col("top.c"), F.col("v") - F.col("top.v"))).otherwise(1).alias("few"),
                                   F.when(large, blocks(F.col("top.c"), F.col("top.v"))).otherwise(0).alias("many"), F.col("top.root").alias("top")))
    d = merged(d, counts, by).withColumn("common", (F.col("many") > 0) & (F.col("root") == F.col("top"))).withColumn("h", F.xxhash64("sid", "key"))
    d = d.withColumn("mine", F.when(F.col("common"), F.col("few") + F.pmod("h", F.greatest("many", F.lit(1)))).otherwise(F.pmod("h", "few")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("common"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
    d = d.select(*by, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).alias("right"), "sid", "root", "fp")
    tile = [*by, "lo", "hi"]
    lists = merged(d, one.select("sid", "n", "odd"), "sid").groupBy(*tile).agg(F.collect_list(F.struct("right", "sid", "root", "fp", "n", "odd")).alias("l"))
    kinds = "near boolean, key bigint, lo bigint, hi bigint, right boolean, sid bigint, root bigint, fp bigint"
    some = written(lists.where("size(l) > 1").mapInArrow(_involved, kinds))
    lists = merged(some, sets, "sid").groupBy(*tile).agg(F.collect_list(F.struct("right", "sid", "root", "fp", "s")).alias("l"))
    return lists.mapInArrow(_linking, "a bigint, b bigint").distinct()


class Sets:
    """Sets of one list, by the size of their parities: which of the other side can be alike to one of them."""

    def __init__(self, near: bool, lo: int, hi: int, rows: pa.StructArray, ns: np.ndarray, odds: list[bytes]) -> None:
        self.right = rows.field("right").to_numpy(zero_copy_only=False).astype(bool)
        self.sid, self.root, self.fp = (rows.field(x).to_numpy() for x in ("sid", "root", "fp"))
        self.ns, self.near, self.alone = ns, near, lo == hi
        self.odd = [np.frombuffer(x, np.uint64) for x in odds]
        by: dict[int, list[int]] = {}
        for i in np.flatnonzero(self.right | self.alone).tolist():
            by.setdefault(len(self.odd[i]), []).append(i)
        self.by = [(np.array(at), np.stack([self.odd[i] for i in at])) for at in by.values()]

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in np.flatnonzero(~self.right | self.alone).tolist():
            for at, odds in self.by:
                stay = possible(self.ns[i], self.odd[i], self.ns[at], odds) & (self.root[at] != self.root[i])
                if self.near:
                    stay &= np.bitwise_count(self.fp[at].view(np.uint64) ^ self.fp[i:i + 1].view(np.uint64)) <= simhash.DISTANCE
                if stay.any():
                    yield i, at[stay]


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with parities in; those of their rows out that can be alike to some row of the other side and another root."""
    names = ["near", "key", "lo", "hi", "right", "sid", "root", "fp"]
    for b in batches:
        for i in range(b.num_rows):
            head, rows = [b.column(k)[i].as_py() for k in range(4)], b.column(4)[i].values
            sets = Sets(head[0], *head[2:], rows, rows.field("n").to_numpy(), rows.field("odd").to_pylist())
            some = np.zeros(len(rows), bool)
            for j, others in sets.pairs():
                some[j] = some[others] = True
            if some.any():
                kept = rows.filter(pa.array(some))
                first = [pa.array([h] * len(kept), t) for h, t in zip(head, (pa.bool_(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*first, *[kept.field(k) for k in names[4:]]], names)


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with sets in; pairs of roots out that keep together all that alike sets link."""
    for b in batches:
        us, vs = [], []
        for i in range(b.num_rows):
            rows = b.column(4)[i].values
            values = [x.values.to_numpy().view(np.uint64) for x in rows.field("s")]
            sets = Sets(b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py(), rows, np.array([len(x) for x in values]), [odd(x) for x in values])
            up = {r: r for r in sets.root.tolist()}

            def top(r: int) -> int:
                while up[r] != r:
                    up[r] = r = up[up[r]]
                return r

            for j, others in sets.pairs():
                for k in others.tolist():
                    x, y = top(int(sets.root[j])), top(int(sets.root[k]))
                    if x == y:
                        continue
                    both = len(np.intersect1d(values[j], values[k], assume_unique=True))
                    if 100 * both >= LEAST * (len(values[j]) + len(values[k]) - both):
                        up[x] = y
                        us.append(x)
                        vs.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["a", "b"])


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, v, sid) of every row, and (node, root) of the sets that have links."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.xxhash64("text").alias("v"), "text")
    rows = written(d.mapInArrow(_signatures, f"doc_id {kind}, v bigint, sid bigint, bands array<bigint>, finer array<bigint>, n bigint, odd binary, fp bigint"))
    one = written(rows.groupBy("sid").agg(F.min_by(F.struct("bands", "finer", "n", "odd", "v"), "v").alias("x")).select("sid", "x.*"))

    def sets(sids: DataFrame) -> DataFrame:
        """One text for every set asked for, hashed again: a set is several times as large as its text."""
        pick = merged(one.select("sid", "v"), sids, "sid", "left_semi")
        text = d.groupBy("v").agg(F.min("text").alias("text"))  # copies meet before they are joined
        return merged(text, pick, "v").select("sid", "text").mapInArrow(_sets, "sid bigint, s array<bigint>")

    marks = rows.where("size(bands) > 0").select("sid", "fp").distinct()  # a text without words is alike to its own kind only
    return rows.select("doc_id", "v", "sid"), _roots(one, marks, sets)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, v (hash of the text), sid (hash of the shingle set), root: the same for all that links reach.

    Two texts are linked if their shingle sets have a Jaccard likeness of ``LEAST`` percent or more and their
    fingerprints are within 3 bits, or they share a band key. Null and empty texts are alike; very long texts are
    hashed piece by piece; equal rows stay as many rows; rows without doc_id are linked like any others; an
    empty table gives an empty result; other columns are not read.
    """
    rows, root = _linked(docs)
    return merged(rows, root, rows["sid"] == root["node"], "left").select("doc_id", "v", "sid", F.coalesce("root", "sid").alias("root"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest by (doc_id, nulls last, hash of the text).

    Of several rows that agree in both, the least by a hash of all columns that can be hashed. Cases as in ``near_copies``.
    """
    rows, root = _linked(docs)
    least = rows.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("least"))
    least = merged(least, root, least["sid"] == root["node"], "left").withColumn("root", F.coalesce("root", "sid"))
    keep = least.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("keep_id"), F.col("least.v").alias("keep_v"))
    columns = [F.col(f"`{f.name}`") for f in docs.schema]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()]
    d = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("v"), F.xxhash64(*plain).alias("h"))
    d = merged(d, keep, d["id"].eqNullSafe(keep["keep_id"]) & (d["v"] == keep["keep_v"]), "left_semi")
    return d.groupBy("id", "v").agg(F.min_by("row", "h").alias("row")).select("row.*")
