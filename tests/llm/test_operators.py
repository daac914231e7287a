import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codestrata.llm import chat, chunkdedup, linededup, mixing, ordermin, packing, quality, sharding, simhash, toxicity

from . import brute
from .conftest import prose, rows

PAIRS = [(r[0], r[1]) for r in rows()]


def multiset(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# --- 1 mixing ----------------------------------------------------------------------------

WEIGHTS = {"s0": 3, "s1": 2, "s2": 4}


def test_mixing_follows_the_slot_by_slot_schedule(docs):
    out = mixing.mix(docs, WEIGHTS, rest_weight=1, block_chars=700).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in PAIRS)
    names = [*WEIGHTS]
    mine = defaultdict(list)
    for r in out:
        mine[names.index(r.source) if r.source in names else 3].append(r)
    blocks = [max((r.block for r in mine[i]), default=-1) + 1 for i in range(4)]
    want = {b: t for t, b in enumerate(brute.schedule(blocks, [3, 2, 4, 1]))}
    for i, got in mine.items():
        at = 0
        for r in sorted(got, key=lambda r: r.offset if r.n_chars else r.offset - 0.5):
            assert r.offset == at and r.block == at // 700 and r.slot == want[i, r.block]
            at += r.n_chars


def test_mixing_is_less_than_a_block_off(spark):
    weights, blocks = [7, 3, 2, 1], [50, 400, 9, 33]
    sizes = spark.createDataFrame(list(enumerate(blocks)), "g int, blocks bigint")
    plan = mixing.rounds(sizes, weights).collect()
    slots = {}
    for r in plan:
        for turn in range(r.lo, r.hi):
            slots[r.base + (turn - r.lo) * r.n + r.t] = (r.g, turn)
    assert sorted(slots) == list(range(sum(blocks)))
    by_turn = defaultdict(Counter)
    for g, turn in slots.values():
        by_turn[turn][g] += 1
    at, seen = 0, Counter()
    for turn in sorted(by_turn):
        share, before, n = by_turn[turn], Counter(seen), sum(by_turn[turn].values())
        for t in range(1, n + 1):
            seen[slots[at][0]] += 1
            at += 1
            assert all(abs(seen[g] - before[g] - share[g] * t / n) < 1 for g in range(4))


def test_mixing_edges(empty, docs):
    assert mixing.mix(empty, WEIGHTS).count() == 0
    assert mixing.mix(docs, {}, 2, 1000).count() == len(PAIRS)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


# --- 2 packing ---------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(hist, k):
    sizes, counts = [*hist], [*hist.values()]
    got = packing.boundaries(sizes, counts, k)
    top = max(sizes)
    assert len(got) <= k and got[-1] == top
    best = min(brute.padding(sizes, counts, [*c, top]) for n in range(k) for c in itertools.combinations(sorted(sizes), n))
    assert brute.padding(sizes, counts, got) == best


def test_packing_keeps_all_tokens_and_budgets(docs, empty):
    out = packing.pack(docs, max_len=300, buckets=5, batch_tokens=2000).collect()
    want = Counter()
    for d, t in PAIRS:
        n = len((t or "").encode().split())
        for p in range(max(1, -(-n // 300))):
            want[d, p, p * 300, min(300, n - p * 300)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in out) == want
    hist = Counter(r.n_tokens for r in out)
    bounds = packing.boundaries([*hist], [*hist.values()], 5)
    batches = defaultdict(list)
    for r in out:
        assert r.padded_len == bounds[r.bucket] and (r.bucket == 0 or bounds[r.bucket - 1] < r.n_tokens) and r.n_tokens <= r.padded_len
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rs in batches.items():
        size = max(1, 2000 // max(1, bounds[bucket]))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= size
        assert len(rs) == size or (bucket, batch + 1) not in batches
    assert packing.pack(empty).count() == 0


# --- 3 line dedup ------------------------------------------------------------------------

def test_line_dedup_equals_brute_force(docs, empty):
    out = linededup.dedup_lines(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    left = brute.line_dedup(PAIRS)
    assert multiset(out, "doc_id", "text") == Counter((d, t if t is None else left[d, t]) for d, t in PAIRS)
    assert linededup.dedup_lines(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.sets(st.integers(0, 9), max_size=5))
def test_covered_positions_merge(lines, starts):
    starts = {s for s in starts if s + 3 <= len(lines)}
    gone = {s + i for s in starts for i in range(3)}
    assert linededup.strip_lines("\n".join(lines), list(starts)) == "\n".join(x for i, x in enumerate(lines) if i not in gone)


# --- 4 toxicity --------------------------------------------------------------------------

def labelled(spark):
    rng, rude, out = random.Random(3), "grobun grobas grobiu kretna kretix".split(), []
    for i in range(900):
        words = prose(rng, rng.randint(20, 120)).split(" ")
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "er", "ol"]))
        out.append((i, " ".join(words), toxic))
    d = spark.createDataFrame(out, "doc_id bigint, text string, toxic int").repartition(4)
    return d.select("doc_id", "text"), d.select("doc_id", "toxic", F.lit(9).alias("text"), F.lit(1).alias("label"))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).select("score", "toxic").collect()
    right = sum((r.score >= toxicity.THRESHOLD) == (r.toxic == 1) for r in got)
    assert len(got) > 150 and right / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_edges(docs, empty, spark):
    labels = spark.createDataFrame([(3, 0), (3, 1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.trees is None
    assert toxicity.score(docs, model).count() == len(PAIRS)
    assert toxicity.fit(empty, labels).share == 0.0
    lex = toxicity.Lexicon()
    assert toxicity.features("", lex) == [0.0] * len(toxicity.FEATURES)
    f = dict(zip(toxicity.FEATURES, toxicity.features("you 1d10t, st0pid st*pid YOU", lex)))
    assert f["near_second"] > 0 and f["hidden_hits"] > 0 and f["obfuscated"] > 0 and f["capital_words"] > 0


# --- 5 simhash ---------------------------------------------------------------------------

def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_simhash_equals_all_pairs(docs, empty):
    got = multiset(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    assert got == Counter((d, signed(f), c) for d, f, c in brute.simhash(PAIRS))
    assert simhash.near_duplicates(empty).count() == 0


def test_links_keep_every_component(spark, monkeypatch):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b for b in base}
    for b in base:  # chains and balls around each, at distances on both sides of the limit
        for _ in range(30):
            b ^= sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(b)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[max(top(a), top(b), key=signed)] = min(top(a), top(b), key=signed)
    monkeypatch.setattr(simhash, "BLOCK", 8)  # so that blocks are compared pair by pair
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {f: got.get(signed(f), signed(f)) for f in fps} == {f: signed(top(f)) for f in fps}


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 3000).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    out = simhash.components(edges)
    assert out.count() == 3000 and out.select("root").distinct().collect()[0][0] == 0


# --- 6 quality ---------------------------------------------------------------------------

def test_quality_measures_equal_brute_force(docs, empty):
    model = quality.Model(np.zeros(2 * quality.PLACES, np.float32), 0.0, 0.0, 30.0)
    want = Counter()
    for d, t in PAIRS:
        t = t or ""
        w = [x.decode() for x in brute.WORD.findall(t.encode())]
        lines = [x for x in t.split("\n") if brute.WORD.search(x.encode())]
        n_rep = brute.repeat_words(w)
        failed = len(w) < 10 or 100 * n_rep > 20 * len(w)
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n_rep, failed, not failed] += 1
    assert multiset(quality.judge(docs, model), "doc_id", *quality.BASE, "base_failed", "kept") == want
    assert quality.judge(empty, model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if k[-1])


def test_quality_on_unseen_rows(spark):
    rng, out = random.Random(8), []
    for i in range(800):
        t = prose(rng, rng.randint(30, 90))
        bad = i % 4 == 0
        out.append((i, " ".join(w + rng.choice(["$$$", "###", "!!"]) for w in t.split()) if bad else t, None if i >= 600 else int(not bad)))
    d = spark.createDataFrame(out, "doc_id bigint, text string, quality int")
    model = quality.fit(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    got = quality.judge(d, model).where("doc_id >= 600").collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in got) >= 0.97 * len(got)
    none = quality.fit(d.limit(0), d.select("doc_id", "quality"))
    assert none.probability("a b c") > 0.99


def test_long_texts_hash_like_short_ones(monkeypatch):
    t = prose(random.Random(1), 500)
    a = quality.hashed(t)
    monkeypatch.setattr(quality, "CHUNK", 97)
    b = quality.hashed(t)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


# --- 7 fingerprints ----------------------------------------------------------------------

def test_neighbours_equal_brute_force(docs, empty):
    got = ordermin.compare_neighbours(docs, range_chars=3000).collect()

    def version(t):
        v = brute.xxhash.xxh64_intdigest(t.encode(), 42)
        return v - (1 << 64) if v >> 63 else v

    order = sorted(((d, t or "") for d, t in PAIRS), key=lambda r: (r[0] is None, -(r[0] or 0), version(r[1])))
    want = Counter()
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        e = t[:len(t) - third] + after[:third]
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), ordermin.fingerprint(t), ordermin.fingerprint(e)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
    assert ordermin.compare_neighbours(empty).count() == 0
    one = ordermin.compare_neighbours(docs.where("doc_id = 500")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def slow_fingerprint(text):
    h = ordermin._numbered(text)
    assert len(set(h.tolist())) == len(h)
    out = []
    for j in range(ordermin.TUPLES):
        rank = (h ^ ordermin._MIX[0, j]) * ordermin._MIX[1, j]
        out.append(tuple(sorted(sorted(range(len(h)), key=lambda i: int(rank[i]))[:ordermin.PICKS])))
    return h, out


def test_order_minhash_is_what_it_says():
    t = prose(random.Random(4), 300)
    assert ordermin.fingerprint(t) == ordermin.fingerprint(t + "")
    h, picks = slow_fingerprint(t)
    want = np.zeros(ordermin.TUPLES, np.uint64)
    for p in range(ordermin.PICKS):
        want = (want ^ h[[x[p] for x in picks]]) * np.uint64(0x9E3779B97F4A7C15)
        want ^= want >> np.uint64(31)
    assert ordermin.fingerprint(t) == (want >> np.uint64(48)).astype(">u2").tobytes().hex()
    words = t.split()
    swapped = " ".join(words[150:] + words[:150])  # the same k-mers but two, in another order
    small = " ".join(words[:100] + ["new"] + words[101:])
    assert ordermin.likeness(ordermin.fingerprint(t), ordermin.fingerprint(small)) > ordermin.likeness(ordermin.fingerprint(t), ordermin.fingerprint(swapped)) + 0.1
    assert ordermin.fingerprint("") == ordermin.fingerprint(None) == "0" * 256


def test_fingerprints_follow_edits_without_blanks_and_in_short_texts():
    rng = random.Random(41)
    plain = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(2000))
    other = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(2000))
    f = ordermin.fingerprint
    assert ordermin.likeness(f(plain), f("x" + plain)) > 0.9
    assert ordermin.likeness(f(plain), f(plain[:900] + plain[901:])) > 0.9
    assert ordermin.likeness(f(plain), f(other)) < 0.2
    near, far = [], []
    for _ in range(100):
        t, u = prose(rng, rng.randint(2, 4)), prose(rng, 4)
        near.append(ordermin.likeness(f(t), f(ordermin.edited(t, u))))
        far.append(ordermin.likeness(f(t), f(u)))
    assert min(near) > 0.1 and sum(near) / 100 > 0.4 > 0.1 + sum(far) / 100


def test_fingerprints_of_all_rows(docs, empty):
    assert ordermin.fingerprints(docs).count() == len(PAIRS) and ordermin.fingerprints(empty).count() == 0


# --- 8 substring dedup -------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcdé 😀", max_size=400))
def test_cuts_equal_the_rolling_hash(t):
    data = t.encode()
    assert chunkdedup.cuts(data).tolist() == brute.gear_cuts(data, chunkdedup.GEAR, chunkdedup.MEAN, chunkdedup.LEAST)


def test_cuts_resist_insertions():
    t = prose(random.Random(2), 2000).encode()
    a, b = set(chunkdedup.cuts(t).tolist()), set(chunkdedup.cuts(b"inserted " + t).tolist())
    assert len({x + 9 for x in a} & b) > 0.98 * len(a)


def test_substring_dedup_equals_brute_force(docs, empty):
    seen, want = {}, Counter()
    chunks, pairs = {}, [p for p in PAIRS if p[0] != 7]  # two texts under one id have no order
    for d, t in sorted({(d, t) for d, t in pairs if t}, key=lambda r: brute.key(r[0])):
        at, own = 0, []
        for to in chunkdedup.cuts(t.encode()).tolist():
            piece = t.encode()[at:to]
            seen.setdefault(piece, d)
            own.append((at, to, piece))
            at = to
        chunks.setdefault(d, []).append(own)
    for d, t in pairs:
        gone = set()
        for own in chunks.get(d, []):
            mine = set()
            for a, z, piece in own:
                if seen[piece] != d or piece in mine:
                    gone.add((a, z))
                mine.add(piece)
        data, at, kept = (t or "").encode(), 0, []
        for a, z in chunkdedup.spans([*gone]) if t else []:
            kept.append(data[at:a])
            at = z
        want[d, None if t is None else b"".join([*kept, data[at:]]).decode(errors="replace")] += 1
    got = multiset(chunkdedup.dedup_substrings(docs.where("doc_id is null or doc_id <> 7")), "doc_id", "text")
    assert got == want
    assert chunkdedup.dedup_substrings(empty).count() == 0


def brute_substrings(pairs):
    """Counter of (doc_id, text left), documents in (doc_id, hash of the text) order, repeated rows as one."""
    def version(t):
        v = brute.xxhash.xxh64_intdigest(t.encode(), 42)
        return v - (1 << 64) if v >> 63 else v

    seen, left = set(), {}
    for d, t in sorted({(d, t) for d, t in pairs if t}, key=lambda r: (brute.key(r[0]), version(r[1]))):
        data, at, gone = t.encode(), 0, []
        for to in chunkdedup.cuts(data).tolist():
            if data[at:to] in seen:
                gone.append((at, to))
            seen.add(data[at:to])
            at = to
        at, kept = 0, []
        for a, z in chunkdedup.spans(gone):
            kept.append(data[at:a])
            at = z
        left[d, t] = b"".join([*kept, data[at:]]).decode()
    return Counter((d, left.get((d, t), t)) for d, t in pairs)


def test_substring_dedup_tells_texts_of_one_id_apart(docs, spark):
    """Id 7 with both its texts, and null ids with different non-ASCII texts that share passages."""
    rng = random.Random(31)
    shared = prose(rng, 60).replace("e", "é")
    nulls = [(None, f"{prose(rng, 30 + 7 * i).replace('a', 'ä')} {shared} {prose(rng, 40).replace('o', '😀')}") for i in range(6)]
    nulls += [(9000, nulls[0][1]), (7, shared + " " + shared)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(nulls, "doc_id bigint, text string"))
    assert multiset(chunkdedup.dedup_substrings(d), "doc_id", "text") == brute_substrings(PAIRS + nulls)


def test_passages_of_fifty_words_are_found():
    rng, caught, alone = random.Random(9), 0, 0
    for _ in range(200):
        passage, a, b = prose(rng, 51), prose(rng, 80), prose(rng, 80)
        first, second = f"{prose(rng, 80)} {passage} {a}".encode(), f"{b} {passage} {prose(rng, 80)}".encode()
        def pieces(data):
            at = 0
            for to in chunkdedup.cuts(data).tolist():
                yield at, to, data[at:to]
                at = to
        known = {p for _, _, p in pieces(first)}
        found = chunkdedup.spans([(x, y) for x, y, p in pieces(second) if p in known])
        lo, hi = len(b.encode()) + 1, len(b.encode()) + 1 + len(passage.encode())
        caught += sum(min(y, hi) - max(x, lo) for x, y in found if x < hi and y > lo) > 0.4 * (hi - lo)
        alone += any(y <= lo or x >= hi for x, y in found)
    assert caught >= 196 and alone == 0


def test_whole_passages_go(spark):
    """Nearly all bytes of each repeated passage of 51 words go, and nothing around it."""
    rng, data, where = random.Random(33), [], {}
    for i in range(150):
        passage, b = prose(rng, 51), prose(rng, 80)
        if i % 3 == 0:
            passage, b = passage.replace("e", "é"), b.replace("a", "😀")
        data += [(i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"), (1000 + i, f"{b} {passage} {prose(rng, 80)}")]
        where[1000 + i] = (len(b.encode()) + 1, len(b.encode()) + 1 + len(passage.encode()))
    d = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    gone = {r.doc_id: r.spans for r in chunkdedup.dedup_passages(d).collect()}
    assert all(not gone[i] for i in range(150))
    shares = []
    for i, (lo, hi) in where.items():
        shares.append(sum(max(0, min(s.end, hi) - max(s.start, lo)) for s in gone[i]) / (hi - lo))
        assert all(s.start >= lo - 8 and s.end <= hi + 8 for s in gone[i])
    assert sum(x > 0.98 for x in shares) >= 149 and sum(shares) / 150 > 0.99


def test_passages_keep_every_byte_once(docs, empty, spark):
    rng = random.Random(34)
    shared = prose(rng, 60).replace("e", "é")
    more = [(None, f"{prose(rng, 20)} {shared} é{prose(rng, 20)}") for _ in range(4)] + [(7, shared + " " + shared), (8, "ab" * 900), (9, "éè" * 900)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = chunkdedup.dedup_passages(d).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in PAIRS + more)
    left = "\0".join(r.text or "" for r in got)
    assert all(w in left for w in shared.split()) and left.count(shared) == 1
    assert sum(r.text is None for r in got) == sum(t is None for _, t in PAIRS)
    assert chunkdedup.dedup_passages(empty).count() == 0


def test_shared_passages_go(docs):
    out = {r.doc_id: r for r in chunkdedup.dedup_substrings(docs).where("doc_id between 80 and 84").collect()}
    text = dict(PAIRS)
    assert out[80].text == text[80]
    assert all(len(out[i].text) < 0.75 * len(text[i]) for i in range(81, 85))


# --- 9 sharding --------------------------------------------------------------------------

def test_sharding_balances_and_keeps_groups(docs, empty, spark):
    rng = random.Random(6)
    many = [(i, prose(rng, rng.randint(5, 60))) for i in range(3000)] + [(5000 + i, "the same text here") for i in range(1500)]
    d = spark.createDataFrame(many, "doc_id bigint, text string").repartition(6)
    out = sharding.shard(d).collect()
    for value in (lambda r: 1, lambda r: r.size, lambda r: r.n_tokens):
        sums = Counter()
        for r in out:
            sums[r.shard] += value(r)
        assert len(sums) == 8 and max(sums.values()) < 1.02 * min(sums.values())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size) for r in small) == Counter((d, len((t or "").encode()) + 1) for d, t in PAIRS)
    assert sharding.shard(empty).count() == 0


def test_sharding_splits_repeated_rows_and_rows_without_ids(spark):
    rng = random.Random(8)
    same = [(None, "without any id")] * 4000 + [(7, "under one id")] * 4000  # two thirds of all rows
    d = spark.createDataFrame([(i, prose(rng, rng.randint(5, 60))) for i in range(4000)] + same, "doc_id bigint, text string").repartition(7)
    out = sharding.shard(d)
    rows_ = out.collect()
    assert Counter((r.doc_id, r.size) for r in rows_) == Counter((i, len(t.encode()) + 1) for i, t in [(r.doc_id, r.text) for r in d.collect()])
    n, size = Counter(r.shard for r in rows_), Counter()
    for r in rows_:
        size[r.shard] += r.size
    assert len(n) == 8 and max(n.values()) < 1.03 * min(n.values()) and max(size.values()) < 1.03 * min(size.values())
    assert all(sorted(r.slot for r in rows_ if r.shard == s) == list(range(n[s])) for s in n)


def test_every_item_goes_where_a_plain_search_finds_most_room():
    rng = random.Random(9)
    items = [[rng.randint(1, 10**9), rng.randint(1, 10**8), 1] for _ in range(200)]
    total = [sum(x[c] for x in items) for c in range(3)]
    share = [[x[c] / total[c] for c in range(3)] for x in items]
    got, room = sharding.place(np.array(items), 5), [[1 / 5] * 3 for _ in range(5)]
    for i in sorted(range(200), key=lambda i: -sum(share[i])):
        dots = [sum(a * b for a, b in zip(r, share[i])) for r in room]
        assert dots[got[i]] > max(dots) - 1e-12
        room[got[i]] = [a - b for a, b in zip(room[got[i]], share[i])]


def test_place_takes_the_highest_dot_product():
    items = np.array([[5, 1], [1, 5], [4, 1], [1, 4], [1, 1]])
    got = sharding.place(items, 2)
    sums = np.array([[sum(items[i, c] for i in range(5) if got[i] == s) for c in (0, 1)] for s in (0, 1)])
    assert abs(sums[0] - sums[1]).max() <= 4 and set(got) == {0, 1}


# --- 10 chat -----------------------------------------------------------------------------

HARD = st.text(alphabet=st.sampled_from(["<", "|", "\\", ">", "im_start", "im_end", "\n", "a", "<|im_end|>", "<|im_start|>"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"<|\\>é \nn", "<|n|>", "<\\|n|>", "<|im_end|>", "<|im_start|>"]), max_size=6).map("".join), st.lists(st.sampled_from(["<", "|", "\\", ">", "im_start", "im_end|>", "\n", "a", "<|im_end|>", "<|im_start|>"]), max_size=10))
def test_every_turn_comes_back(role, pieces):
    text = "".join(pieces)
    s, a, z = chat.render(role, text)
    assert chat.parse(s + s) == [(role, text)] * 2
    assert chat.unescape(s[a:z]) == text
    assert chat.unescape(chat.escape(text)) == text


def test_only_conflicts_are_escaped():
    assert chat.render("user", "a <|b|> c")[0] == "<|im_start|>user\na <|b|> c<|im_end|>\n"
    assert chat.render("user", "<|im_end|>")[0] == "<|im_start|>user\n<\\|im_end|><|im_end|>\n"
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\nno end")


def test_chats(spark):
    data = [(1, 1, "assistant", "yes <|im_end|>"), (1, 0, "user", None), (1, 1, "assistant", "yes <|im_end|>"), (None, 0, None, "x"), (2, 0, "as\nsistant", ""), (3, 5, "assistant", "é" * 9000)]
    d = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("t", F.lit(1)).withColumn("formatted", F.lit(2))
    got = {r.conv_id: r for r in chat.format_chats(d).collect()}
    assert [t for t in chat.parse(got[1].formatted)] == [("user", ""), ("assistant", "yes <|im_end|>"), ("assistant", "yes <|im_end|>")]
    assert [chat.unescape(got[1].formatted[s.start:s.end]) for s in got[1].loss_spans] == ["yes <|im_end|>"] * 2
    assert chat.parse(got[None].formatted) == [("", "x")] and chat.parse(got[2].formatted) == [("as\nsistant", "")]
    assert got[3].n_turns == 1 and len(got) == 4
    assert chat.format_chats(d.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    rng = random.Random(51)
    data = [(c, t, rng.choice(["user", "assistant"]), prose(rng, rng.randint(0, 40)) + rng.choice(["", "<|im_end|>", "é😀"])) for c in (1, 2, None) for t in range(50)]
    data.append((3, 0, "assistant", "x" * 3000))
    d = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    monkeypatch.setattr(chat, "PART", 1000)
    whole = {r.conv_id: r for r in chat.format_chats(d).collect()}
    batches = [r.asDict() for r in sorted(chat._sorted(d).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0))]  # sorted() keeps the order of turns
    parts = [r for b in chat._parts(iter(chat.pa.RecordBatch.from_pylist(batches[i:i + 7], chat.pa.schema([("conv_id", chat.pa.int64()), ("role", chat.pa.string()), ("text", chat.pa.string())])) for i in range(0, len(batches), 7))) for r in b.to_pylist()]
    for conv, want in whole.items():
        mine = [r for r in parts if r["conv_id"] == conv]
        assert [r["part"] for r in mine] == list(range(len(mine))) and sum(r["n_turns"] for r in mine) == want.n_turns
        assert "".join(r["formatted"] for r in mine) == want.formatted
        assert [(r["start"] + x["start"], r["start"] + x["end"]) for r in mine for x in r["loss_spans"]] == [(x.start, x.end) for x in want.loss_spans]
        assert all(len(r["formatted"]) <= 1000 or r["n_turns"] == 1 for r in mine) and (conv == 3 or len(mine) > 3)
    assert chat.format_parts(d).count() == 4
    for r in chat.read_back(d).collect():
        turns = chat.parse(whole[r.conv_id].formatted)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.formatted_chars, r.loss_chars) == (len(turns), len(whole[r.conv_id].formatted), sum(len(b) for a, b in turns if a == "assistant"))
