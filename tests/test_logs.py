import json
import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions.ordered import position, running
from codestrata.operators import consensus as C
from codestrata.sources import corpus, ground_truth as GT, history as H
from codestrata.streaming import live, machines as M, requests as Q
from conftest import rows


def log(seed, n=400):
    """One client holds a third of the rows; bursts, exact one-minute gaps and equal times occur."""
    r = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += r.choice([0, 500, 1000, 3000, 60_000 if r.random() < 0.1 else 2000])
        out.append((i, 0 if r.random() < 0.34 else r.randrange(1, 5), t))
    return out


def replay(data, step):
    state, out = {}, {}
    for i, k, t in sorted(data, key=lambda x: (x[2], x[0])):
        state[k], out[i] = step(state.get(k, []), t, (10, 20))
    return out


@pytest.mark.parametrize("chunks", [1, 7])
def test_ordered_scans_equal_a_replay(spark, chunks):
    data = log(chunks)
    df = spark.createDataFrame(data, "request_id long, client long, ts_ms long")
    got = {r.request_id: (r.allowed, r.remaining, r.reset_seconds) for r in Q.rate_limit(df, chunks).collect()}
    assert got == replay(data, M.rate_step)
    keyed = df.withColumn("fingerprint_key", F.concat(F.lit("k"), F.col("client").cast("string")))
    assert {r.request_id: (r.is_duplicate,) for r in Q.dedup_requests(keyed, chunks).collect()} == replay(data, M.dedup_step)


def test_limits_at_the_edge():
    s = []
    for t in range(10):
        s, out = M.rate_step(s, t, ())
    assert out == (True, 0, 60)
    assert M.rate_step(s, 60_000, ())[1][0] is False  # the first request is exactly a minute old and still counts
    assert M.rate_step(s, 60_001, ())[1][0] is True
    assert M.dedup_step([0], 299_999, ())[1] == (True,) and M.dedup_step([0], 300_000, ())[1] == (False,)
    assert M.reuse_step([0, 0, 5, 6], 30 * 60_000 - 1, (1, 2))[1] == (True, 5, 6)
    assert M.reuse_step([0, 0, 5, 6], 30 * 60_000, (1, 2))[1] == (False, 0, 0)
    assert M.reuse_step([0, 59 * 60_000, 5, 6], 60 * 60_000 + 1, (1, 2))[1][0] is False


def test_throttle_window_crosses_buckets(spark):
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate([59_000] * 3 + [60_000, 119_000, 119_001])], "request_id long, agent string, ts_ms long")
    got = {r.request_id: (r.calls, r.is_throttled, r.wait_ms) for r in Q.throttle_status(df, limit=4).collect()}
    assert got == {0: (3, False, 0), 1: (3, False, 0), 2: (3, False, 0), 3: (4, True, 59_000), 4: (5, True, 0), 5: (3, False, 0)}


def test_throttle_on_dense_calls(spark):
    """Many calls in a minute: no frame slides, as its work grows with calls times calls; same rows as brute force."""
    rng = random.Random(8)
    data = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(-70_000, 200_000, 777)])) for k in range(900)]
    got = Q.throttle_status(spark.createDataFrame(data, "request_id long, agent string, ts_ms long"), limit=4)
    want = {}
    for k, a, t in data:
        if t is not None:
            near = [u for _, b, u in data if b == a and u is not None and t - 60_000 <= u <= t]
            want[k] = (a, len(near), len(near) >= 4, 60_000 - t + min(near) if len(near) >= 4 else 0)
    assert {r.request_id: (r.agent, r.calls, r.is_throttled, r.wait_ms) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in plan and "RangeFrame, -60000" not in plan


def test_running_and_position(spark):
    data = [(i % 3 if i % 2 else 0, i, i * i) for i in range(80)]
    df = spark.createDataFrame(data, "k int, o int, v long")
    got = {(r.k, r.o): r.s for r in running(df, ["k"], ["o"], {"s": F.col("v")}, chunks=6).collect()}
    assert got == {(k, o): sum(v for kk, oo, v in data if kk == k and oo <= o) for k, o, _ in data}
    pos = {r.o: r.position for r in position(df, [F.desc("o")], chunks=5).collect()}
    assert pos == {o: 79 - o for o in range(80)}


def test_consensus_rules(spark):
    a = spark.createDataFrame([(1, 1, "SecurityAgent", "HIGH", 80, False), (2, 1, "OtherAgent", "LOW", 85, False), (3, 1, "X", "HIGH", 0, True)],
                              "analysis_id long, project long, agent string, priority string, confidence int, is_error boolean")
    assert rows(C.agreement(a), "agreement_pct") == [(66.6667,)]
    assert rows(C.team_confidence(a), "confidence") == [(57,)]
    assert rows(C.priority_conflicts(a), "priority", "n", "agents") == [("HIGH", 2, "SecurityAgent,X")]
    r = spark.createDataFrame([(1, "T", 2.5, "critical"), (2, "T", 1.0, " "), (2, "U", 4.0, "LOW"), (3, "T", 9.0, "HIGH")], "analysis_id long, title string, hours double, priority string")
    r = r.withColumn("hours", F.col("hours").cast("decimal(12,2)"))
    assert [(x[0], x[1], float(x[2])) for x in rows(C.synthesise_recs(r, a), "bucket", "n", "hours")] == [("high", 1, 2.5), ("long term", 1, 4.0), ("medium", 1, 1.0)]
    assert rows(C.title_conflicts(r, a), "title", "n") == [("T", 3)]
    half = spark.createDataFrame([(1, 1, "a", "", 82, False), (2, 1, "b", "", 83, False)], a.schema)
    assert rows(C.team_confidence(half), "confidence") == [(82,)]  # half to even


def tree(tmp_path):
    (tmp_path / "sub" / "deep er").mkdir(parents=True)
    (tmp_path / "sub" / "a.cs").write_bytes(b"class A\r\n{ }")
    (tmp_path / "sub" / "deep er" / "b+c.go").write_bytes("\ufeffpackage é".encode())
    (tmp_path / "sub" / "deep er" / "bad.py").write_bytes(b"x = '\xff\xfe'")
    (tmp_path / "empty.py").write_bytes(b"")
    (tmp_path / "big.js").write_bytes(b"x" * (1024 * 1024 + 1))
    (tmp_path / "note.md").write_text("no")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.cs").write_text("no")
    return tmp_path


def test_corpus_source(spark, tmp_path):
    got = {r.file_name: (r.content, r.status, r.language) for r in corpus.read_corpus(spark, str(tree(tmp_path)), max_mb=1).collect()}
    assert got == {"a.cs": ("class A\n{ }", "Completed", "csharp"), "empty.py": ("", "Completed", "python"), "big.js": (None, "Error", "javascript"),
                   "b+c.go": ("package é", "Completed", "go"), "bad.py": ("x = '\ufffd\ufffd'", "Completed", "python")}
    whole = {r.file_name: (r.status, len(r.content), r.error) for r in corpus.read_corpus(spark, f"file://{tmp_path}", keep_empty=False).where("content IS NOT NULL").collect()}
    assert whole == {"a.cs": ("Completed", 11, None), "big.js": ("Completed", 1024 * 1024 + 1, None), "b+c.go": ("Completed", 9, None), "bad.py": ("Completed", 8, None)}


def test_corpus_rows_of_what_cannot_be_read(spark, tmp_path):
    """A root that is not there, a single file as the root, and a file that goes between listing and reading."""
    assert [(r.status, "no such" in r.error) for r in corpus.read_corpus(spark, str(tmp_path / "none")).collect()] == [("Error", True)]
    (tmp_path / "one.py").write_text("x = 1")
    assert [r.content for r in corpus.read_corpus(spark, str(tmp_path / "one.py")).collect()] == ["x = 1"]
    late = corpus.read_corpus(spark, str(tmp_path))
    (tmp_path / "one.py").rename(tmp_path / "two.py")
    assert [(r.file_name, r.status, r.content) for r in late.collect()] == [("one.py", "Error", None)]
    (tmp_path / "bare").mkdir()
    assert corpus.read_corpus(spark, str(tmp_path / "bare")).count() == 0


def test_corpus_is_listed_and_dealt_by_tasks(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"d{i % 5}" / f"e{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 5}" / f"e{i % 3}" / f"f{i}.py").write_text(f"x = {i}\n" * 200)
    monkeypatch.setattr(corpus, "BUDGET", 10 * corpus.OPENING)
    df = corpus.read_corpus(spark, str(tmp_path))
    assert sorted(r.content[:8].strip() for r in df.collect()) == sorted(f"x = {i}\nx "[:8].strip() for i in range(40))
    assert df.select(F.spark_partition_id()).distinct().count() >= 4
    index = corpus._by_index(spark, str(tmp_path), ("py",), None)
    assert index.count() == 40 and rows(index, "content") == rows(corpus._by_tasks(spark, str(tmp_path), ("py",), None), "content")


def test_ground_truth_source(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"ID": "d1", "Files": [{"FileName": "a.cs", "language": "csharp", "ISSUECOUNT": 2}],\n "issues": [{"Id": "1", "Category": "x", "severity": "LOW"},'
                                     ' {"Id": "2", "Category": "x", "severity": "HIGH", "isMandatory": false, "lineNumber": 4, "expectedDetectorAgents": ["s"]}]}')
    files, issues = GT.read_ground_truth(spark, str(tmp_path))
    assert rows(files, "dataset_id", "fileName", "issueCount") == [("d1", "a.cs", 2)]
    got = {r.id: (r.lineNumber, r.isMandatory, r.expectedDetectorAgents) for r in issues.collect()}
    assert got == {"1": (None, True, []), "2": (4, False, ["s"])}


def test_ground_truth_spellings_and_types(spark, tmp_path):
    """Documents that differ in spelling and types lie in one folder; a file may hold a list; wrong members are null."""
    (tmp_path / "a.json").write_text('[{"ID": 7, "FILES": [{"filename": "x.cs", "LineCount": "12", "issuecount": 2.0}]},\n {"id": "b", "Issues": [{"ID": 5, "linenumber": "n/a", "TAGS": ["t"], "extra": {"deep": [1]}}], "files": "none"}]')
    (tmp_path / "b.json").write_text('{"issues": [{"id": "q", "isMandatory": false, "expecteddetectoragents": null}], "files": []}')
    (tmp_path / "empty.json").write_text("\n")
    files, issues = GT.read_ground_truth(spark, str(tmp_path))
    assert rows(files, "dataset_id", "fileName", "lineCount", "issueCount") == [("7", "x.cs", 12, 2)]
    got = {r.id: (r.dataset_id, r.lineNumber, r.tags, r.isMandatory, r.expectedDetectorAgents) for r in issues.collect()}
    assert got == {"5": ("b", None, ["t"], True, []), "q": (None, None, None, False, [])}
    (tmp_path / "c.json").write_text("{ not json")
    with pytest.raises(Exception, match="no JSON"):
        GT.read_ground_truth(spark, str(tmp_path))[1].collect()


def test_ground_truth_is_read_once(spark, tmp_path):
    """No pass over the input before the read: making the tables reads nothing, so a broken file fails only when rows are asked for."""
    (tmp_path / "c.json").write_text("{ not json")
    GT.read_ground_truth(spark, str(tmp_path))


GT_FILES = "dataset_id string, fileName string, language string, content string, relativePath string, issueCount int, lineCount int"
GT_ISSUES = ("dataset_id string, id string, fileName string, category string, description string, severity string, location string, lineNumber int, codeSnippet string, "
             "expectedDetectorAgents array<string>, tags array<string>, isMandatory boolean, difficultyLevel string")


def test_ground_truth_comes_back(spark, tmp_path):
    files = [(d, f"f{i}.cs", "csharp", 'say "hi"\n\\ {é}', None, i, None) for i in range(9) for d in ("one", "two/ü:", None)] + [("files only", "z", None, "", "p", None, 3)]
    issues = [("one", f"i{i}", None, "cat", "[,]}", "HIGH" if i % 2 else None, "x:1", i, "a\nb", ["s", "p"][:i % 3], None if i % 2 else ["t"], bool(i % 2), "easy") for i in range(7)] + [
        ("issues only", "k", "f", "c", "d", "LOW", "l", None, None, [], None, True, None), (None, "n", None, "cat", None, "LOW", None, 1, None, [], [], False, None)]
    f, i = spark.createDataFrame(files, GT_FILES).withColumn("more", F.lit(1)), spark.createDataFrame(issues, GT_ISSUES).repartition(3)

    def all_of(df):
        return sorted(map(repr, df.collect()))

    for _ in range(2):  # a second write replaces the first for readers
        GT.write_ground_truth(f.where("issueCount < 3 OR issueCount IS NULL"), i, str(tmp_path / "s"))
        GT.write_ground_truth(f, i, str(tmp_path / "s"))
        back = GT.read_ground_truth(spark, str(tmp_path / "s"))
        assert all_of(back[0]) == all_of(f.drop("more")) and all_of(back[1]) == all_of(i)
    heads = {(r.dataset_id, r.dimension, r.label): r.n for r in GT.read_statistics(spark, str(tmp_path / "s")).collect()}
    assert heads["one", "total files", ""] == 9 and heads["one", "severity", "HIGH"] == 3 and heads["one", "language", "csharp"] == 36 and heads[None, "total issues", ""] == 1
    GT.write_ground_truth(f.limit(0), i.limit(0), str(tmp_path / "none"))
    assert GT.read_ground_truth(spark, str(tmp_path / "none"))[0].count() == 0


def test_a_document_is_read_by_lines(spark, tmp_path):
    """No whole document is held: a file of one dataset is split between tasks; ids that are empty, missing or look alike stay apart."""
    issues = [(d, f"i{k}", "f", "c", "x" * 200, "LOW", "l", k, None, [], None, True, None) for d in ("", None, "1", "01", "null", "=") for k in range(200)]
    f, i = spark.createDataFrame([("", "f", "csharp", None, None, 1, 1)], GT_FILES), spark.createDataFrame(issues, GT_ISSUES)
    GT.write_ground_truth(f, i, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        back = GT.read_ground_truth(spark, str(tmp_path))
        assert back[1].rdd.getNumPartitions() > 20
        assert sorted(map(repr, back[1].collect())) == sorted(map(repr, i.collect())) and rows(back[0], "dataset_id", "fileName") == [("", "f")]
        totals = {r.dataset_id: r.n for r in GT.read_statistics(spark, str(tmp_path)).where("dimension = 'total issues'").collect()}
        assert totals == dict.fromkeys(["", None, "1", "01", "null", "="], 200)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # every dataset still is one document of JSON
    docs = [json.loads(p.read_text()) for p in tmp_path.glob("lines-*/*/part-*")]
    assert len(docs) == 6 and all([x["id"] for x in d["issues"]] == sorted(x["id"] for x in d["issues"]) and len(d["issues"]) == 200 for d in docs)


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path):
    f = spark.createDataFrame([("one", "f", "csharp", None, None, 1, 1)], GT_FILES)
    i = spark.createDataFrame([], GT_ISSUES)
    GT.write_ground_truth(f, i, str(tmp_path))
    bad = f.withColumn("fileName", F.when(F.col("issueCount") == 1, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        GT.write_ground_truth(bad, i, str(tmp_path))
    assert rows(GT.read_ground_truth(spark, str(tmp_path))[0], "fileName") == [("f",)]


def test_history(spark, tmp_path):
    s = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-01 10:00:00'), (2L, TIMESTAMP_NTZ'2024-01-02 09:00:00'), (3L, TIMESTAMP_NTZ'2024-01-02 09:00:00') t(id, created_at)")
    f = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c")], "session_id long, file_name string")
    H.append_session(s, str(tmp_path / "h"))
    H.append_session(s.where("id = 3").withColumn("id", F.lit(4).cast("long")), str(tmp_path / "h"))
    back = H.read_sessions(spark, str(tmp_path / "h"))
    assert [r.id for r in H.recent_sessions(back, 3).collect()] == [4, 3, 2]
    assert rows(H.session_by_id(s, f, 3), "file_name") == [("b",), ("c",)] and H.session_by_id(s, f, 2).count() == 1
    kept, kids = H.purge(s, f, cutoff="2024-01-02", session_id=3)
    assert rows(kept, "id") == [(2,)] and kids.count() == 0


def stored(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "data" in p.parts}


def test_purge_writes_only_the_days_that_lose_rows(spark, tmp_path):
    s = spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-01 10:00:00' + make_dt_interval(CAST(id DIV 2 AS INT)) AS created_at FROM range(12)")
    H.append_session(s, str(tmp_path / "s"))
    H.append_session(s.select(F.col("id").alias("session_id"), "created_at", F.lit("f").alias("file_name")), str(tmp_path / "f"))
    before = stored(tmp_path)
    assert H.purge_store(spark, str(tmp_path / "s"), str(tmp_path / "f"), session_id=4) == (1, 1)
    kept, kids = (H.read_sessions(spark, str(tmp_path / p)) for p in "sf")
    left = [(i,) for i in range(12) if i != 4]
    assert rows(kept, "id") == rows(kids, "session_id") == left and kept.columns == ["id", "created_at", "created_date"]
    after = stored(tmp_path)
    assert all(after[p] == t for p, t in before.items()) and len(after) == len(before) + 2  # one new file in each store
    opened = [f.replace("%20", " ") for f in H._stored(spark, str(tmp_path / "s")).select("id").inputFiles()]
    assert len(opened) >= 6
    # whole days go: nothing is written for them but the log
    assert H.purge_store(spark, str(tmp_path / "s"), str(tmp_path / "f"), cutoff="2024-01-03") == (2, 2)
    assert rows(H.read_sessions(spark, str(tmp_path / "s")), "id") == [(i,) for i in range(5, 12)]
    assert H.purge_store(spark, str(tmp_path / "s"), str(tmp_path / "f"), session_id=99) == (0, 0)
    H.append_session(s.where("id = 4"), str(tmp_path / "s"))  # a later append of the same day counts
    assert rows(H.read_sessions(spark, str(tmp_path / "s")), "id") == [(i,) for i in range(4, 12)]
    assert rows(H.read_sessions(spark, str(tmp_path / "s"), version=1), "id") == [(i,) for i in range(12)]


def test_a_purge_that_broke_off_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    s = spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-01 10:00:00' + make_dt_interval(CAST(id AS INT)) AS created_at FROM range(4)")
    H.append_session(s, str(tmp_path / "s"))
    H.append_session(s.select(F.col("id").alias("session_id"), "created_at"), str(tmp_path / "f"))
    real, calls = H.versions.commit, []

    def commit(spark, root, ops):
        calls.append(root)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(spark, root, ops)

    monkeypatch.setattr(H.versions, "commit", commit)
    with pytest.raises(RuntimeError):
        H.purge_store(spark, str(tmp_path / "s"), str(tmp_path / "f"), session_id=2)
    assert rows(H.read_sessions(spark, str(tmp_path / "s")), "id") == [(0,), (1,), (2,), (3,)]
    H.purge_store(spark, str(tmp_path / "s"), str(tmp_path / "f"), session_id=2)
    assert rows(H.read_sessions(spark, str(tmp_path / "s")), "id") == rows(H.read_sessions(spark, str(tmp_path / "f")), "session_id") == [(0,), (1,), (3,)]


def stream_of(spark, tmp_path, df):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_streams_equal_batch(spark, tmp_path):
    data = log(11, 150)
    df = spark.createDataFrame(data, "request_id long, client long, ts_ms long").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = live.run_available(live.rate_limit_stream(stream_of(spark, tmp_path, df)))
    assert {r.request_id: (r.allowed, r.remaining, r.reset_seconds) for r in got.collect()} == replay(data, M.rate_step)


def test_builtin_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "k", 10**12), (2, "k", 10**12 + 1000), (3, "j", 10**12)], "request_id long, fingerprint_key string, ts_ms long").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = live.run_available(live.dedup_stream(stream_of(spark, tmp_path, df)))
    assert sorted(r.fingerprint_key for r in got.collect()) == ["j", "k"]


def test_feed_and_cost_run_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "Challenge"), (1, "a", "Analysis"), (2, "b", "Analysis")], "conv_id long, from_agent string, type string")
    q = Q.message_feed(stream_of(spark, tmp_path, df)).writeStream.format("memory").queryName("feed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("feed")) == rows(Q.message_feed(df))
    u = spark.createDataFrame([(1, "op", "GPT-4", 1000, 1000), (1, "op", "gpt-35-turbo", 1000, 0)], "client long, operation string, model string, input_tokens long, output_tokens long")
    assert rows(Q.usage_cost(u), "input_tokens", "cost") == [(2000, 0.0915)]


def test_reuse_stream_equals_batch(spark, tmp_path):
    data = log(21, 120)
    df = spark.createDataFrame(data, "request_id long, client long, ts_ms long").withColumn("ts", F.timestamp_millis("ts_ms"))
    df = df.select("request_id", "ts_ms", "ts", F.lit("a").alias("agent"), F.col("client").cast("string").alias("fingerprint_key"), F.lit("gpt-4").alias("model"),
                   F.lit(7).cast("long").alias("input_tokens"), F.col("request_id").alias("output_tokens"))
    want = rows(Q.reuse_outcomes(df, 3), "request_id", "hit", "saved_tokens", "saved_nano")
    assert any(r[1] for r in want) and rows(live.run_available(live.reuse_stream(stream_of(spark, tmp_path, df))), "request_id", "hit", "saved_tokens", "saved_nano") == want


def test_throttle_live_equals_batch_out_of_order(spark, tmp_path):
    r, data, t = random.Random(5), [], 10**12
    for i in range(600):
        t += r.choice([0, 0, 700, 2500, 59_000 if r.random() < 0.02 else 1500])
        data.append((i, "a" if r.random() < 0.34 else r.choice(["b", "c", None]), t))
    last = t
    # rows arrive up to 90 seconds late, in many small files of one trigger each
    arriving = sorted(data, key=lambda x: x[2] + r.randrange(90_000))
    schema = "request_id long, agent string, ts_ms long"
    for n in range(12):
        part = spark.createDataFrame(arriving[n * 50:n * 50 + 50] + ([(900, "a", None)] if n == 3 else []), schema)
        part.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cols = ["request_id", "agent", "calls", "is_throttled", "wait_ms"]
    got = live.run_available(live.throttle_live(stream, "91 seconds", limit=8))
    want = Q.throttle_status(spark.createDataFrame(data, schema), limit=8).join(
        spark.createDataFrame(data, schema).select("request_id", "ts_ms"), "request_id").where(F.col("ts_ms") < last - 91_000)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert want.where("is_throttled").count() > 20 and want.where("not is_throttled").count() > 20


def test_throttle_live_drops_what_is_too_late(spark, tmp_path):
    # the watermark that a batch sets holds for lateness from the batch after the next one on
    schema = "request_id long, agent string, ts_ms long"
    for part in ([(1, "a", 600_000)], [(2, "a", 900_000)], [(5, "b", 900_000)], [(3, "a", 600_001)], [(4, "a", 2_000_000)]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert rows(live.run_available(live.throttle_live(stream, "1 minute")), "request_id", "calls") == [(1, 1), (2, 1), (5, 1)]
