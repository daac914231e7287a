import random
import re

from pyspark.sql import functions as F

from codestrata.operators import parse as P, validate as VD
from conftest import rows

OK = '{"confidenceScore": 80, "findings": [{"category": "X", "description": "d"}], "recommendations": []}'


def responses(spark, *raws, agent="security"):
    return spark.createDataFrame([(str(i), agent, r) for i, r in enumerate(raws)], "response_id string, agent string, raw string")


def test_extract_json_forms(spark):
    raws = [OK, f"text ```json\n{OK}\n``` end", f"```\n{OK}```", f"Before {OK} after", OK.replace("]}", ",]}"), "{'a': 1,}", "no json", "[1, 2] tail", '{"a": 1} {"b": 2}', "", '{"a": /* c */ 1}']
    got = [r[0] for r in responses(spark, *raws).select(P.extract_json(F.col("raw"))).collect()]
    assert got[:4] == [OK] * 4 and got[4] == OK and got[5] == '{"a": 1}' and got[6] is None and got[7] == "[1, 2]"
    assert got[8] is None and got[9] is None and got[10] is not None


def test_explode_analysis_defaults(spark):
    empty = '{"confidenceScore": 5, "findings": [], "recommendations": [{"title": "T", "estimatedHours": 2.5, "priority": "LOW"}]}'
    a, f, r = P.explode_analysis(responses(spark, OK, empty, '{"confidenceScore": 0}', "prose"))
    assert rows(a, "response_id", "confidence") == [("0", 80), ("1", 5)]
    assert rows(f, "response_id", "severity", "category") == [("0", None, "X"), ("1", "LOW", "Security")] or len(rows(f.select("response_id"))) == 2
    assert rows(r, "title", "estimatedHours") == [("T", 2.5)]
    assert rows(P.unstructured(responses(spark, OK, "prose")), "raw") == [("prose",)]


def test_prose_and_classification(spark):
    text = "Finding: severe SQL injection in a.cs line 4\nmore\nIssue: x\nRecommendation: y\n1. first\n2. second\n- dash\n"
    got = [r[0] for r in P.prose_findings(responses(spark, text)).select("finding_text").collect()]
    assert got == ["severe SQL injection in a.cs line 4\nmore", "x", "first", "second", "dash"]
    fallback = P.prose_findings(responses(spark, "All fine. A risk here! A risk here! Done."))
    assert rows(fallback, "finding_text") == [("A risk here!",)]
    d = spark.createDataFrame([("severe SQL injection in a.cs line 4", "s"), ("minor method Foo", "s"), ("plain", "s")], "finding_text string, agent string")
    assert rows(P.classify_finding(d), "category", "severity", "location") == [("SQL Injection", "CRITICAL", "a.cs line 4"), ("s", "LOW", "Method Foo"), ("s", "MEDIUM", "")]
    e = spark.createDataFrame([("abc", "x ABC then ```cs\ncode\n``` end")], "finding_text string, raw string")
    assert P.finding_evidence(e).first().evidence == ["code", "abc"]


def test_batch_answers(spark):
    raw = '{"analyses": [{"fileName": "B.cs", "assessment": "good"},{"fileName": "x/C.cs", "assessment": "fine"},]}'
    tail = "D.cs: " + "word " * 30
    df = spark.createDataFrame([("1", raw, ["src/B.cs", "C.cs", "Z.cs"]), ("2", "see D.cs: short", ["D.cs"]), ("3", tail, ["d.cs"])], "response_id string, raw string, expected array<string>")
    got = {(r.response_id, r.file_name): (r.source, r.assessment[:4]) for r in P.match_batch_answers(df).collect()}
    assert got == {("1", "src/B.cs"): ("parsed", "good"), ("1", "C.cs"): ("parsed", "fine"), ("1", "Z.cs"): ("default", "Anal"),
                   ("2", "D.cs"): ("default", "Anal"), ("3", "d.cs"): ("text", "word")}


def test_keywords(spark):
    r = responses(spark, "Critical injection risk. injection again. cost here.")
    k = P.keyword_findings(r).first()
    assert (k.category, k.severity, k.evidence) == ("SQL Injection", "CRITICAL", "Critical injection risk | injection again")
    s = P.keyword_scores(r).first()
    assert (s.confidence, s.effort_hours, s.priority, s.risk, s.metric_1, s.metric_3, s.impact) == (40, 8, "CRITICAL", "MEDIUM", 1, 1, "Critical injection risk")
    assert rows(P.keyword_recommendations(r), "title") == [("Implement Parameterized Queries",)]


def test_validation(spark):
    code = "int a = 1;\nif (x) { return a; }\n"
    files = spark.createDataFrame([("a.cs", code)], "file_key string, content string")
    f = spark.createDataFrame([
        (1, "Performance", "HIGH", "a.cs:2", ["return a;"]), (2, "Performance", "HIGH", "a.cs:9", ["return a;"]), (3, "Performance", "CRITICAL", "a.cs:1", ["int a"]),
        (4, "Performance", "HIGH", "a.cs", ["int a"]), (5, "Performance", "HIGH", "b.cs:1", ["int a"]), (6, "Performance", "HIGH", "a.cs:1", ["zz yy int"]), (7, "Other", "CRITICAL", "a.cs:1", ["int"]),
        (8, None, "HIGH", "a.cs:1", ["int"])], "finding_id int, category string, severity string, location string, evidence array<string>")
    got = {r.finding_id: r.status for r in VD.validate_findings(f, files).collect()}
    assert got == {1: "Validated", 2: "Failed", 3: "LowConfidence", 4: "LowConfidence", 5: "LowConfidence", 6: "Validated", 7: "LowConfidence", 8: "Validated"}


def test_evidence_blocks_equal_a_plain_search(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "x", "return", "if", "zeta", "omega"]
    files = [(f"f{i}.cs", " ".join(r.choices(words[:5], k=12)) + ("\n// " + "zeta" if i % 2 else "")) for i in range(6)]
    files += [("f0.cs", "omega omega"), ("f1.cs", files[1][1])]  # two texts under one key, one text twice
    claims = []
    for i in range(300):  # a third speaks about one file
        ev = [" ".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(r.randrange(0, 4))]
        ev += [[], [""], [None], ["// note"]][i % 4] if i % 3 == 0 else []
        claims.append((i, "Other", "LOW", f"f{0 if r.random() < 0.34 else r.randrange(1, 8)}.cs:1", ev if i % 29 else None))

    def plain(t):
        return re.sub(r"/\*.*?\*/", "", re.sub(r"//.*$", "", re.sub(r"\s+", " ", t))).strip().lower()

    def holds(code, e):
        n = plain(e or "")
        ws = n.split()
        return n in code or bool(ws) and sum(w in code for w in ws) >= max(1, len(ws) // 2)

    want = []
    for i, _, _, loc, ev in claims:
        texts = [plain(t) for k, t in files if k == loc[:-2]] or [None]
        want += [(i, c is not None and bool(ev) and all(holds(c, e) for e in ev)) for c in texts]
    f = spark.createDataFrame(claims, "finding_id int, category string, severity string, location string, evidence array<string>")
    d = spark.createDataFrame(files, "file_key string, content string")
    assert rows(VD.validate_findings(f, d), "finding_id", "evidence_present") == sorted(want)
    code = spark.createDataFrame([(k, i, plain(t)) for i, (k, t) in enumerate(files[:6])], "file_key string, version int, code string")
    asked = f.select(VD.file_of(F.col("location")).alias("file_key"), "evidence").where(F.size("evidence") > 0)
    small, large = (rows(VD.evidence_support(asked, code, n).select("file_key", F.col("evidence").cast("string").alias("e"), "supported")) for n in (2, 512))
    assert small == large and {x[2] for x in small} == {True, False}


def test_confidence_and_triage(spark):
    d = spark.createDataFrame([([150, -5, 50, 50], 0), ([50, 50, 50, 50], None), ([1, 2, 3, 4], 130)], "parts array<int>, score int")
    # 100*.35 + 0 + 10 + 5 = 50
    assert [r.confidence for r in VD.normalise_confidence(d).collect()] == [50, 50, 100]
    steps = spark.sql("SELECT array(named_struct('step_number', 7, 'd', 'a'), named_struct('step_number', 3, 'd', 'b')) AS s")
    assert [x.step_number for x in steps.select(VD.renumber_steps(F.col("s"))).first()[0]] == [1, 2]
    log = spark.createDataFrame([(1, "TimeoutException", ""), (2, "InvalidOperationException", "Rate Limit"), (3, "X", "HTTP 429"), (4, "X", "?")], "log_id int, error_type string, message string")
    assert rows(VD.error_triage(log), "log_id", "retryable", "delay_seconds", "remedy") == [(1, True, 5, "timeout"), (2, True, 60, "configuration"), (3, False, 5, "rate limit"), (4, False, 5, "general")]
