import base64
import hashlib
import random
import re

from pyspark.sql import functions as F

from codestrata.operators import determinism as D, groundtruth as T
from conftest import rows

SEV = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
FIND = "finding_id long, agent string, category string, severity string, location string"
ISSUE = ("issue_id string, issue_order long, category string, severity string, location string, line_number int, "
         "expected_agents array<string>, is_mandatory boolean, difficulty string")
CATS = ["SQL Injection", "sqli", "sql", "Auth", "authentication", "Design", "arch", "Perf", "perf_tuning", "", "Odd"]
PLACES = ["Cart.cs:10", "Cart.cs:14", "Cart.cs", "cart.cs line 12", "", "Main.java#7", "Main"]


def norm(c):
    return c.strip().lower().replace("_", " ").replace("-", " ")


def line_of(loc):
    for p in [r":(\d+)", r"line\s+(\d+)", r"#(\d+)"]:
        m = re.search(p, loc, re.IGNORECASE)
        if m:
            return int(m.group(1))
    return None


def score(f, i):
    a, b = norm(f[2]), norm(i[2])
    cat = a in b or b in a or any(a in [k, *v] and b in [k, *v] for k, v in T.SYNONYMS.items())
    fs, gs = f[3].upper(), i[3].upper()
    sev = fs in SEV and gs in SEV and abs(SEV.index(fs) - SEV.index(gs)) <= 1
    fl, gl = line_of(f[4]), i[5]
    if fl is not None and gl is not None:
        loc = abs(fl - gl) <= 5
    else:
        loc = bool(f[4]) and bool(i[4]) and (f[4].lower() in i[4].lower() or i[4].lower() in f[4].lower())
    return ((0.5 if cat else 0) + (0.3 if sev else 0) + (0.2 if loc else 0)) * 100


def sample(seed, n=120):
    r = random.Random(seed)
    # one category holds a third of both sides
    cat = lambda: "SQL Injection" if r.random() < 0.34 else r.choice(CATS)
    fs = [(k, r.choice(["security", "performance"]), cat(), r.choice([*SEV, "odd", "high"]), r.choice(PLACES)) for k in range(n)]
    gs = [(f"G{k}", k, cat(), r.choice([*SEV, "weird"]), r.choice(PLACES), r.choice([None, 8, 12, 30]), r.choice([[], ["Security"], ["performance", "x"]]), r.random() < 0.8, "easy") for k in range(n)]
    return fs, gs


def test_matching_equals_brute_force(spark):
    for seed in (1, 2):
        fs, gs = sample(seed)
        f, g = spark.createDataFrame(fs, FIND), spark.createDataFrame(gs, ISSUE)
        want, cand = {}, {}
        for x in fs:
            best = None
            for i in gs:
                s = score(x, i)
                if s >= 70:
                    cand[(x[0], round(s, 6))] = cand.get((x[0], round(s, 6)), 0) + 1
                if s > (best[0] if best else 0):
                    best = (s, i[0])
            if best and best[0] >= 70:
                want[x[0]] = (round(best[0], 6), best[1])
        got = {r.finding_id: (round(r.confidence, 6), r.issue_id) for r in T.gt_match(f, g).where("issue_id IS NOT NULL").collect()}
        assert got == want
        assert {(r.finding_id, round(r.confidence, 6)): r.n_issues for r in T.gt_candidates(f, g).collect()} == cand


def test_metrics_follow_the_matches(spark):
    fs, gs = sample(3, 60)
    f, g = spark.createDataFrame(fs, FIND), spark.createDataFrame(gs, ISSUE)
    v = T.with_verdict(T.gt_match(f, g)).cache()
    tp = {r.finding_id: (r.agent, r.issue_id) for r in v.where("is_tp").collect()}
    hit = {i for _, i in tp.values()}
    m = T.gt_metrics(v, g).first()
    fn = [i for i in gs if i[7] and i[0] not in hit]
    assert (m.tp, m.fp, m.fn) == (len(tp), len(fs) - len(tp), len(fn)) and m.tp + m.fp == len(fs)
    for r in T.gt_metrics_by_agent(v, g).collect():
        mine = {i for a, i in tp.values() if a == r.agent}
        assert r.fn == sum(1 for i in gs if i[7] and i[0] not in mine and (not i[6] or r.agent in [x.lower() for x in i[6]]))
    assert sum(r.tp for r in T.gt_metrics_by_category(v, g).collect()) == len(tp)
    assert sorted(r.severity for r in T.gt_metrics_by_severity(v, g).collect()) == sorted(SEV)
    empty = T.gt_metrics(v.where("false"), g.where("false")).first()
    assert (empty.precision, empty.recall, empty.f1, empty.accuracy, empty.quality) == (0, 0, 0, 0, "LOW")
    assert {r.more for r in T.gt_top_errors(v, g).where("kind = 'false negative'").collect()} == {max(len(fn) - 5, 0)}


def test_match_plan_has_no_pair_join(spark):
    fs, gs = sample(4, 20)
    plan = T.gt_match(spark.createDataFrame(fs, FIND), spark.createDataFrame(gs, ISSUE))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def runs(spark):
    data = [(1, 1, "A", "HIGH", "x.cs:1"), (1, 2, "A", "HIGH", "x.cs:9"), (1, 3, "B", "LOW", "line 3"), (2, 4, "A", "LOW", "x.cs:4"), (2, 5, "B", "LOW", "Line 7"), (3, 6, "C", "LOW", "q")]
    return spark.createDataFrame([(r, i, "sec", c, s, loc) for r, i, c, s, loc in data], "run_number int, finding_id long, agent string, category string, severity string, location string")


def test_run_consistency(spark):
    c = {r.finding_key: r for r in D.run_consistency(runs(spark), 4).collect()}
    a = c["a|x.cs:*"]
    assert a.appearances == 3 and a.runs_seen == 2 and a.rate == 75.0 and not a.one_severity and a.severities == "HIGH,LOW"
    assert c["b|line *"].rate == 50.0 and c["c|q"].rate == 25.0
    s = D.run_stats(runs(spark), D.run_consistency(runs(spark), 4), 4).first()
    assert (s["keys"], s.full, s.high, s.moderate, s.moderate_band, s.poor) == (3, 0, 0, 0, 2, 1)
    assert (s.avg_findings, s.min_findings, s.max_findings, s.sd_findings) == (1.5, 0, 3, 1.118)
    assert D.run_by(D.run_consistency(runs(spark), 4), "category").count() == 0
    assert D.run_score(D.run_consistency(runs(spark), 4)).first().level == "Poor"


def test_run_similarity_and_hash(spark):
    got = {(r.run_a, r.run_b): r.similarity for r in D.run_similarity(runs(spark)).collect()}
    assert got == {(1, 2): 100.0, (1, 3): 0.0, (2, 3): 0.0}
    texts = ["A:HIGH:x.cs:1", "A:HIGH:x.cs:9", "B:LOW:line 3"]
    total = sum(int(hashlib.md5(f"{i}|{t}".encode()).hexdigest()[:15], 16) for i, t in enumerate(texts, 1))
    want = base64.b64encode(hashlib.sha256(f"3:{total}".encode()).digest()).decode()[:16]
    assert {r.run_number: r.run_hash for r in D.run_hash(runs(spark)).collect()}[1] == want
    # equal runs hash alike, and the order counts
    one = runs(spark).where("run_number = 1")
    again = one.unionByName(one.withColumn("run_number", F.lit(9))).unionByName(one.withColumn("run_number", F.lit(8)).withColumn("finding_id", -F.col("finding_id")))
    h = {r.run_number: r.run_hash for r in D.run_hash(again).collect()}
    assert h[1] == h[9] == want != h[8]
