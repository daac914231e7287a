import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import linededup, mixing, neardup, packing, quality, simhash

from . import brute
from .conftest import SCHEMA, prose, rows


def alike(texts):
    """Groups (a representative per text) that pairs of 5-word Jaccard of 0.8 and more link, over all pairs."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {t: shingles(t) for t in texts}
    distinct = list(set(sets.values()))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(a)] = find(b)
    return {t: find(s) for t, s in sets.items()}


def survivors(docs, v):
    """One (doc_id, text, source) of each group: the least by (doc_id, nulls last, hash of the text, hash of the row)."""
    group = alike({t for _, t, _ in docs})
    best = {}
    for d, t, s in docs:
        place = (d is None, d or 0, v[t], v[d, t, s])
        if group[t] not in best or place < best[group[t]][0]:
            best[group[t]] = (place, (d, t, s))
    return [x for _, x in best.values()]


def expected(spark, data, model):
    """The rows of the stages one after the other over Python lists, and at the end those of near-dedup."""
    def good(t):
        w = (t or "").encode().split()
        return len(w) >= 10 and 5 * brute.repeat_words(w) <= len(w) and model.probability(t) >= quality.THRESHOLD

    docs = [r for r in data if good(r[1])]
    left = brute.line_dedup([(d, t) for d, t, *_ in docs])
    docs = [(d, left[d, t], *rest) for d, t, *rest in docs]
    hashed = spark.createDataFrame(docs, SCHEMA).select("doc_id", "text", "source", F.xxhash64("text").alias("v"), F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("h")).collect()
    v = {r.text: r.v for r in hashed} | {(r.doc_id, r.text, r.source): r.h for r in hashed}
    return survivors([(d, t, s) for d, t, _, s, _ in docs], v)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Also with ids that are missing and ids that stand for two texts; repeated rows differ in source."""
    rng = random.Random(31)
    base = prose(rng, 120)
    data = rows() + [(300, base, "en", "s1", 1), (300, base, "en", "s2", 1), (None, base.replace(base.split()[60], "edited", 1), "en", "s0", 1)]
    words = prose(rng, 200).split()
    for i in range(6):  # scattered edits: 0.8 of Jaccard, far beyond 3 bits
        w = list(words)
        for k in rng.sample(range(200), 2):
            w[k] = f"new{i}x{k}"
        data.append((310 + i if i else None, " ".join(w), "en", "s1", 1))
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    want = expected(spark, data, model)
    assert sum(d is not None and 310 <= d < 316 for d, _, _ in want) == 1 and sum(d == 300 for d, _, _ in want) == 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = Counter()
    for d, t, _ in want:
        n = len((t or "").encode().split())
        for p in range(max(1, -(-n // packing.MAX_LEN))):
            pieces[d, p, min(packing.MAX_LEN, n - p * packing.MAX_LEN)] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == pieces
    # batches of a bucket follow the mixing order
    last = spark.createDataFrame(want, "doc_id bigint, text string, source string")
    place = {r.doc_id: (r.slot, r.offset, r.doc_id) for r in mixing.mix(last, mixing.WEIGHTS).collect() if r.doc_id is not None}
    twice = {d for d, n in Counter(d for d, _, _ in want).items() if n > 1}
    by_bucket = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.bucket, r.batch, r.slot)):
        if r.doc_id is not None and r.doc_id not in twice:
            by_bucket[r.bucket].append((*place[r.doc_id],))
    assert all(b == sorted(b) for b in by_bucket.values())


def test_joins_of_growing_tables_go_by_shuffles(spark, tmp_path):
    """Keys are exploded from fingerprints that Spark takes for small; as broadcasts they fill the driver."""
    d = spark.createDataFrame(rows(), SCHEMA)
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    one = neardup.written(spark.range(300).select(F.col("id").alias("sid"), F.array(F.col("id") % 50, F.col("id") % 40).alias("bands")))
    shared = neardup._shared(one.select("sid", F.explode("bands").alias("key")))
    for df in (simhash.links(fps), shared, linededup.dedup_lines(d), mixing.stage(spark, d, ""), neardup.stage(spark, d, "")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the schedule of a round is bounded by its sources
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin [g#") == plan.count("BroadcastHashJoin"), plan


def test_which_of_repeated_rows_stays_is_fixed(spark):
    data = [(1, "one text of its own", f"s{i}", i) for i in range(40)]
    got = {tuple(neardup.stage(spark, spark.createDataFrame(random.Random(k).sample(data, 40), "doc_id bigint, text string, source string, row int").repartition(k + 1), "").first()) for k in range(3)}
    assert len(got) == 1


def test_clashing_names_and_maps_stay(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 5, 6, {"x": 1}), (2, "a b c d e f", 7, 8, {"y": 2}), (3, "other words are in this one", 9, 10, None)],
                              "doc_id bigint, text string, keep_id int, row int, h map<string,int>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("a.b", F.lit(3))
    out = neardup.stage(spark, d, "")
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_strangers_under_the_keys_of_one_template(spark):
    """Copies of a template that are 0.6 alike share keys; each one's near copy is found, and rows stay in proportion."""
    rng, template, texts = random.Random(24), prose(random.Random(25), 200).split(), []
    for i in range(120):
        w = list(template)
        for k in rng.sample(range(200), 5):
            w[k] = f"w{i}x{k}"
        texts.append(" ".join(w))
        w[rng.randrange(200)] = f"v{i}"
        texts.append(" ".join(w))
    want = alike(set(texts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.root for r in neardup.near_copies(d).collect()}
    linked = [i for i in range(0, 240, 2) if want[texts[i]] is want[texts[i + 1]]]
    assert len(linked) > 110 and sum(got[i] == got[i + 1] for i in linked) >= 0.97 * len(linked)
    assert all(want[texts[i]] is want[texts[j]] for i in range(240) for j in range(i) if got[i] == got[j])


def test_stages_keep_the_columns(docs, empty, spark, tmp_path):
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for d in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() >= d.count()


def test_near_copies_with_scattered_edits_go(spark):
    """Pairs of 5-word Jaccard of 0.8 and more are one group, pairs below are not; 3 bits of SimHash miss most of them."""
    rng, texts, alike = random.Random(21), [], 0
    for i in range(60):
        a = prose(rng, 300).split()
        b = list(a)
        for k in rng.sample(range(5, 295), rng.choice([3, 5, 6])):
            b[k] = "edited"
        c = a[:150] + prose(rng, 150).split()  # half new: stays
        texts += [(3 * i, " ".join(a)), (3 * i + 1, " ".join(b)), (3 * i + 2, " ".join(c))]
    shingles = [{tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)} for _, t in texts]
    want = set(range(180))
    for i in range(60):
        a, b = shingles[3 * i], shingles[3 * i + 1]
        if 5 * len(a & b) >= 4 * len(a | b):
            want.discard(3 * i + 1)
            alike += 1
    assert alike >= 30
    d = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in neardup.stage(spark, d, "").collect()} == want


def test_a_pair_without_a_common_band_meets_by_its_fingerprints(spark):
    """0.8 alike and within 3 bits, but no band in common: SimHash finds what MinHash misses."""
    rng = random.Random(14)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(40)] * 12
    texts = [" ".join(passage + [f"{c}{rng.randrange(10**6)}" for _ in range(5)]) for c in "ab"]
    a, b = map(neardup.shingles, texts)
    assert 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)) and (simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).bit_count() <= 3
    assert not set(neardup.signature(a)[0]) & set(neardup.signature(b)[0])
    d = spark.createDataFrame([*enumerate(texts), (2, prose(rng, 300)), (3, ""), (4, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in neardup.stage(spark, d, "").collect()) == [0, 2, 3]


def test_a_pair_that_no_spanning_link_joins_is_found(spark):
    """Two texts are 0.8 alike and share no band; a stranger lies between their fingerprints, so the links within 3 bits go by it."""
    rng = random.Random(14)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(40)] * 12

    def text(seed, n):
        r = random.Random(seed)
        return " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(n)])

    a, b, c = texts = [text(64, 5), text(596, 5), text(5041, 14)]
    group, (fa, fb, fc) = alike(set(texts)), [simhash.fingerprint(t, 5) for t in texts]
    assert group[a] is group[b] is not group[c] and max((x ^ y).bit_count() for x in (fa, fb, fc) for y in (fa, fb, fc)) <= 3
    assert not set(neardup.signature(neardup.shingles(a))[0]) & set(neardup.signature(neardup.shingles(b))[0])
    d = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in neardup.stage(spark, d, "").collect()) == [0, 2]


@pytest.mark.parametrize("block", [8, 512])
def test_groups_are_those_of_all_pairs_whatever_leads_there_are(spark, monkeypatch, block):
    """One lead for each key, small blocks, hot keys: the groups are those of all pairs that share a key or are within 3 bits."""
    monkeypatch.setattr(neardup, "LEVELS", 1)
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    rng, template, texts = random.Random(26), prose(random.Random(27), 60).split(), []
    for i in range(60):
        w = list(template)
        w[rng.randrange(60)] = f"w{i}"
        texts.append(" ".join(w))
        w[rng.randrange(60)] = f"v{i}"
        texts.append(" ".join([*w, f"x{i}"]))
    sets = [neardup.shingles(t) for t in texts]
    bands, fps = [set(neardup.signature(s)[0].tolist()) for s in sets], [simhash.fingerprint(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(set(x.tolist()) & set(y.tolist()))
            if 5 * both >= 4 * (len(x) + len(y) - both) and (bands[i] & bands[j] or (fps[i] ^ fps[j]).bit_count() <= 3):
                root[find(i)] = find(j)
    d = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.root for r in neardup.near_copies(d).collect()}
    want = [find(i) for i in range(len(texts))]
    assert len(set(want)) < len(texts) and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300), st.integers(0, 80), st.integers(0, 80))
def test_parities_rule_out_no_alike_sets(seed, both, left, right):
    v = np.unique(np.random.default_rng(seed).integers(0, 1 << 63, both + left + right, dtype=np.uint64))
    a, b = np.sort(v[:both + left]), np.sort(np.concatenate([v[:both], v[both + left:]]))
    stay = neardup.possible(len(a), np.frombuffer(neardup.odd(a), np.uint64), np.array([len(b)]), np.frombuffer(neardup.odd(b), np.uint64)[None])[0]
    assert stay or 5 * both < 4 * len(v)


def test_near_copies_across_a_chain(spark):
    """A large group whose ends are not alike is one group, also where no set is alike to the least of its key."""
    words = prose(random.Random(22), 400).split()
    chain = [(i, " ".join([f"w{k}" for k in range(i * 10)] + words[i * 10:])) for i in range(30)]
    d = spark.createDataFrame(chain + [(100, None), (101, ""), (102, " ")], "doc_id bigint, text string")
    near = neardup.near_copies(d).collect()
    by = {r.doc_id: r.root for r in near}
    assert len({by[i] for i in range(30)}) == 1 and by[100] == by[101] == by[102] != by[0]
    assert neardup.near_copies(d.limit(0)).count() == 0


def test_one_row_of_each_group_also_without_ids(spark):
    """Null ids and two texts under one id: groups are chosen by row, not by id."""
    rng = random.Random(23)
    a, b, c, e = (prose(rng, 120) for _ in range(4))
    data = [(None, a), (None, a + " more"), (1, b), (None, b + " more"), (7, c), (7, c + " more"), (7, e), (None, None), (None, None)]
    d = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in neardup.stage(spark, d, "").collect()]
    assert len(got) == 5 and (1, b) in got and (7, e) in got and (None, None) in got
    assert sum(t in (a, a + " more") for _, t in got) == 1 and sum(t in (c, c + " more") for _, t in got) == 1


def test_one_row_of_each_group_of_all_rows_without_ids(spark):
    """The whole of rows(), with null ids and the second text of id 7."""
    data = rows()
    d = spark.createDataFrame(data, SCHEMA)
    got = neardup.stage(spark, d, "").collect()
    groups = {(r.doc_id, r.text): r.root for r in neardup.near_copies(d).join(d.select("doc_id", F.xxhash64("text").alias("v"), "text"), "v").select(d["doc_id"], "text", "root").collect()}
    assert sorted(groups[r.doc_id, r.text] for r in got) == sorted(set(groups.values()))
