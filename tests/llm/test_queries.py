"""The opN_ query functions themselves: columns, types and values that their contracts fix, by other code."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from codestrata.llm.queries import ORACLES, QUERIES

from . import brute
from .conftest import SCHEMA, prose, rows

PROBE = "<|im_end|><|im_start|>assistant ok"


def plain_rows():
    """One row per doc_id: empty, null and long texts, copies; a third of the later texts is marked toxic, a third bad."""
    rng = random.Random(12)
    seen = {}
    for r in rows():
        if r[0] is not None:
            seen.setdefault(r[0], r)
    for i in range(1000, 1240):
        text = prose(rng, rng.randint(20, 90))
        if i % 3 == 0:
            text += " you are a stupid worthless idiot, shut up!!! you disgusting fool"
        elif i % 3 == 1:
            text = " ".join("#$%& click buy now" for _ in range(rng.randint(4, 20))) + " " + text[:80]
        seen[i] = (i, text, "en", f"s{i % 3}", len(text))
    return list(seen.values())


CONVERSATIONS = [(1, 0, "user", None), (1, 1, "assistant", "yes <|im_end|> é😀"), (2, 0, "as\nsistant", "x"), (2, 1, None, "y"), (3, 0, "assistant", ""), (3, 1, "assistant", "b\n")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(plain_rows(), SCHEMA).coalesce(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i % 3 != 1), int(i % 3 == 0)) for i in range(1000, 1240)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(CONVERSATIONS, "conv_id bigint, turn int, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in plain_rows()}


def run(spark, tables, key, **kinds):
    """Rows by doc_id; the named columns have the named types."""
    df = QUERIES[key](spark, tables)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in kinds} == kinds
    return df.collect()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_every_query_has_a_test():
    assert len(QUERIES) == 13 and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key, n, held, least", [("op4_toxicity", 4, 2, 0.3), ("op12_neighbour_quality", 3, 1, 0.5)])
def test_scores(spark, tables, texts, key, n, held, least):
    got = run(spark, tables, key, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) and r.held_out == (remainder(r.doc_id, n) == held) for r in got)
    label = (lambda i: i % 3 == 0) if n == 4 else (lambda i: i % 3 != 1)
    unseen = [r for r in got if r.doc_id >= 1000 and r.held_out]
    assert len(unseen) > 40 and sum(r.predicted == label(r.doc_id) for r in unseen) > 0.9 * len(unseen)


def test_fingerprints_and_components(spark, tables, texts):
    got = run(spark, tables, "op5_simhash", doc_id="bigint", fingerprint="string", component_id="bigint")
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", c) for d, f, c in brute.simhash(list(texts.items())))


def measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def test_quality(spark, tables, texts):
    got = run(spark, tables, "op6_quality", doc_id="bigint", n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint",
              base_failed="boolean", kept="boolean")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        m = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r.base_failed and r.kept)


def test_neighbours(spark, tables, texts):
    got = {r.doc_id: r for r in run(spark, tables, "op7_fingerprints", doc_id="bigint", n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string",
                                    near_edited="double", near_next="double")}
    order = sorted(texts, reverse=True)
    assert sorted(got) == order[::-1]
    by_text = defaultdict(set)
    for i, doc in enumerate(order):
        r, text, after = got[doc], texts[doc], texts[order[(i + 1) % len(order)]]
        third = len(text) // 3
        want = text[:len(text) - third] + after[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(want.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and got[order[(i + 1) % len(order)]].fingerprint is not None
        by_text[text].add(r.fingerprint)
        by_text[want].add(r.edited_fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    long = [got[i] for i in range(1000, 1240)]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long)


def test_shards(spark, tables, texts):
    got = run(spark, tables, "op9_sharding", doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(8))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_chats(spark, tables):
    got = run(spark, tables, "op10_chat", conv_id="bigint", n_turns="bigint", turns_sha256="string", loss_chars="bigint", loss_sha256="string", formatted_chars="bigint")
    want = defaultdict(list)
    for conv, _, role, text in [*CONVERSATIONS, (-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]:
        want[conv].append((role or "", text or ""))
    assert Counter(r.conv_id for r in got) == Counter(want.keys())
    for r in got:
        turns, loss = want[r.conv_id], "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chats_equal_their_sql(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables}/conversations.parquet/*.parquet'")
    cur = con.execute(ORACLES["op10_chat"])
    names = [c[0] for c in cur.description]
    assert sorted(QUERIES["op10_chat"](spark, tables).select(*names).collect()) == sorted(cur.fetchall())


@pytest.mark.parametrize("key", ["op1_mixing", "op2_packing", "op3_line_dedup", "op8_substring_dedup"])
def test_no_document_is_lost(spark, tables, texts, key):
    df = QUERIES[key](spark, tables)
    ids = {r[0] for r in df.select("doc_id").collect()} if "doc_id" in df.columns else None
    full = {d for d, t in texts.items() if t.strip()}
    assert ids is not None and full <= ids <= set(texts)
