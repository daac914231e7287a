"""Queries that read raw answers and check the findings in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import keywords as K
from ..data.snippets import EXTENSIONS
from ..functions.text import base_name
from ..operators import graph as G, parse as P, validate as VD
from ..sources import views as V
from .corpus import files
from .graphs import with_safe
from .oracle import VIEWS, lit, pick, q, re2
from .registry import register

# --- JSON ---------------------------------------------------------------------------
register("extract_json", lambda s, d: V.responses(s, d).select("response_id", F.coalesce(P.extract_json(F.col("raw")), F.lit("")).alias("json")), q("""
SELECT r.response_id, CASE WHEN shape = 3 THEN '' ELSE b.body END AS json FROM v_responses r JOIN v_resp1 b ON b.conv_id = r.conv_id AND b.turn = r.turn"""))


def _explode(s, d):
    a, f, r = P.explode_analysis(V.responses(s, d))
    return (a.select("response_id", "agent", F.lit("analysis").alias("part"), F.col("impact").alias("label"), F.col("confidence").cast("double").alias("value"))
            .unionByName(f.select("response_id", "agent", F.lit("finding").alias("part"), F.concat_ws("|", "category", "description", "severity", "location").alias("label"), F.lit(0.0).alias("value")))
            .unionByName(r.select("response_id", "agent", F.lit("recommendation").alias("part"), F.concat_ws("|", "title", "priority").alias("label"), F.col("estimatedHours").alias("value"))))


register("explode_analysis", _explode, q("""
SELECT response_id, agent, 'analysis' AS part, 'cost risk' AS label, CAST(conv_id % 90 + 10 AS DOUBLE) AS value FROM v_responses WHERE shape < 3
UNION ALL SELECT response_id, agent, 'finding', CASE WHEN turn % 3 <> 0 THEN 'SQL Injection|' || first || '|HIGH|' || expected_file || ':7'
  ELSE 'Security|No security issues were detected in the provided context.|LOW|' END, 0 FROM v_responses WHERE shape < 3 AND (turn % 3 <> 0 OR agent = 'security')
UNION ALL SELECT response_id, agent, 'recommendation', 'Fix ' || (turn % 5) || '|HIGH', CAST(conv_id % 40 AS DOUBLE) FROM v_responses WHERE shape < 3"""))
register("parse_semantic_issues", lambda s, d: P.parse_semantic_issues(V.responses(s, d)).select("response_id", "issueType", "category", "lineNumber", "severity"),
         q("SELECT response_id, 'TypeSafety' AS issueType, 'naming' AS category, turn + 1 AS lineNumber, conv_id % 5 AS severity FROM v_responses WHERE shape < 2"))


def _expected(s, d):
    return V.responses(s, d).withColumn("expected", F.array("expected_file", F.concat(F.lit("Missing"), F.col("turn").cast("string"), F.lit(".cs"))))


VIEWS["v_after"] = """SELECT *, regexp_replace(regexp_replace(substr(raw, strpos(lower(raw), lower(expected_file)) + length(expected_file), 2000), '^\\s+|\\s+$', '', 'g'), '^[:\\- \\n\\r]+', '') AS after FROM v_responses"""
register("match_batch_answers", lambda s, d: P.match_batch_answers(_expected(s, d)), q("""
SELECT response_id, expected_file AS file_name, CASE WHEN shape < 3 THEN first ELSE substr(after, 1, 400) END AS assessment, CASE WHEN shape < 3 THEN 'parsed' ELSE 'text' END AS source FROM v_after
UNION ALL SELECT response_id, 'Missing' || turn || '.cs', 'Analysis completed. Detailed review recommended. (Parsed from batch response)', 'default' FROM v_responses"""))

# --- prose ---------------------------------------------------------------------------
VIEWS["v_prose0"] = """
SELECT response_id, agent, raw, unnest(['critical SQL injection in ' || expected_file || ' line 12',
  'high memory risk in class Cart' || chr(10) || '1. Review authentication design' || chr(10) || '- Improve database caching and refactor the pattern']) AS t FROM v_responses WHERE shape = 3
UNION ALL SELECT response_id, agent, raw, unnest(regexp_extract_all(raw, '(?m)^\\d+\\.\\s*(.+)$', 1)) FROM v_responses WHERE shape = 3
UNION ALL SELECT response_id, agent, raw, unnest(regexp_extract_all(raw, '(?m)^[-*]\\s+(.+)$', 1)) FROM v_responses WHERE shape = 3"""
VIEWS["v_prose"] = "SELECT DISTINCT response_id, agent, raw, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS finding_text FROM v_prose0 WHERE trim(t) <> ''"


def prose(s, d):
    return P.prose_findings(P.unstructured(V.responses(s, d)))


register("prose_findings", lambda s, d: prose(s, d).select("response_id", "agent", "finding_text"), q("SELECT response_id, agent, finding_text FROM v_prose"))


def _classified(s, d):
    p = prose(s, d).select("response_id", "agent", "finding_text")
    more = V.findings(s, d).select(F.col("finding_id").cast("string").alias("response_id"), "agent",
                                   F.concat(F.lower("severity"), F.lit(" problem of "), F.lower("description")).alias("finding_text"))
    return P.classify_finding(p.unionByName(more))


VIEWS["v_ftexts"] = ("SELECT response_id, agent, finding_text FROM v_prose UNION ALL SELECT CAST(finding_id AS VARCHAR), agent, "
                     "lower(severity) || ' problem of ' || lower(description) FROM v_findings")
_cat = " ".join(f"WHEN contains(lower(finding_text), '{w.lower()}') THEN '{c}'" for w, c in K.CATEGORY_WORDS)
_sv = " ".join(f"WHEN regexp_matches(finding_text, '(?i){p}') THEN '{c}'" for p, c in K.SEVERITY_WORDS)
_lf = lit("(?i)" + re2(K.LOCATION_FILE))
register("classify_finding", _classified, q(f"""
SELECT response_id, agent, finding_text, CASE {_cat} ELSE agent END AS category, CASE {_sv} ELSE 'MEDIUM' END AS severity,
  CASE WHEN regexp_extract(finding_text, {_lf}, 1) <> '' THEN regexp_extract(finding_text, {_lf}, 1) || CASE WHEN regexp_extract(finding_text, {_lf}, 4) <> '' THEN ' line ' || regexp_extract(finding_text, {_lf}, 4) ELSE '' END
    WHEN regexp_matches(finding_text, '(?i)class\\s+(\\w+)') THEN 'Class ' || regexp_extract(finding_text, '(?i)class\\s+(\\w+)', 1)
    WHEN regexp_matches(finding_text, '(?i)method\\s+(\\w+)') THEN 'Method ' || regexp_extract(finding_text, '(?i)method\\s+(\\w+)', 1) ELSE '' END AS location
FROM v_ftexts"""))
register("finding_evidence", lambda s, d: P.finding_evidence(prose(s, d)).select("response_id", "finding_text", F.array_join("evidence", " | ").alias("evidence")),
         q("SELECT response_id, finding_text, substr(finding_text, 1, 200) AS evidence FROM v_prose"))

# --- keywords -----------------------------------------------------------------------
VIEWS["v_sent"] = "SELECT response_id, agent, raw, list_filter(string_split(raw, '.'), lambda s: s <> '') AS ss FROM v_responses"


def _lev(x: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(ws)}') THEN '{c}'" for ws, c in table) + f" ELSE '{default}' END"


def _kw() -> str:
    out = []
    for spec, rows in K.FINDING_WORDS.items():
        for cat, word in rows:
            w = word.lower()
            ctx = f"coalesce(list_filter(ss, lambda s: contains(lower(s), '{w}'))[1], '')"
            ev = f"array_to_string(list_transform(list_filter(ss, lambda s: contains(lower(s), '{w}'))[1:3], lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), ' | ')"
            out.append(f"SELECT response_id, agent, '{cat}' AS category, '{cat + K.FINDING_TEXT[spec]}' AS description, {_lev(ctx, K.SENTENCE_SEVERITY, 'LOW')} AS severity, {ev} AS evidence "
                       f"FROM v_sent WHERE agent = '{spec}' AND contains(lower(raw), '{w}')")
    return " UNION ALL ".join(out)


register("keyword_findings", lambda s, d: P.keyword_findings(V.responses(s, d)), q(_kw()))


def _has(w: str) -> str:
    return f"CAST(contains(lower(raw), '{w.lower()}') AS INTEGER)"


def _scores_sql() -> str:
    out = []
    for spec in K.FINDING_WORDS:
        conf = " + ".join([_has(w) for w in [*K.CONFIDENCE_BASE, *K.CONFIDENCE_WORDS[spec]]] + ["1", f"CAST(length(raw) > {K.CONFIDENCE_LENGTH[spec]} AS INTEGER)"])
        eff = " + ".join(_has(w) for w in K.EFFORT_WORDS[spec])
        effort = f"CASE {eff} " + " ".join(f"WHEN {k} THEN {h}" for k, h in K.EFFORT_HOURS[spec].items()) + f" ELSE {max(K.EFFORT_HOURS[spec].values())} END"
        risk = "(['LOW','MEDIUM','HIGH','CRITICAL'])[1 + least(3, " + " + ".join(_has(w) for w in K.RISK_WORDS[spec]) + ")]"
        mets = [" + ".join(f"(length(lower(raw)) - length(replace(lower(raw), '{w}', ''))) // {len(w)}" for w in ws) for _, ws in K.METRIC_WORDS[spec]]
        imp = (f"coalesce(regexp_replace(list_filter(ss, lambda s: regexp_matches(lower(s), '{'|'.join(K.IMPACT_WORDS[spec])}'))[1], '^\\s+|\\s+$', '', 'g'), "
               f"'{K.IMPACT_DEFAULT[spec]}')")
        names = ",".join(n for n, _ in K.METRIC_WORDS[spec])
        out.append(f"SELECT response_id, agent, least(100, ({conf}) * {K.CONFIDENCE_STEP[spec]}) AS confidence, {effort} AS effort_hours, {_lev('raw', K.PRIORITY_WORDS, 'LOW')} AS priority, "
                   f"{risk} AS risk, '{names}' AS metric_names, {mets[0]} AS metric_1, {mets[1]} AS metric_2, {mets[2]} AS metric_3, {imp} AS impact FROM v_sent WHERE agent = '{spec}'")
    return " UNION ALL ".join(out)


register("keyword_scores", lambda s, d: P.keyword_scores(V.responses(s, d)), q(_scores_sql()))
register("keyword_recommendations", lambda s, d: P.keyword_recommendations(V.responses(s, d)), q(" UNION ALL ".join(
    f"SELECT response_id, agent, '{t}' AS title, {h}.0::DOUBLE AS hours, '{p}' AS priority FROM v_responses WHERE agent = '{spec}' AND regexp_matches(lower(raw), '{'|'.join(w.lower() for w in ws)}')"
    for spec, ws, t, h, p in K.ADVICE)))

# --- validation ------------------------------------------------------------------------
def _spoken(s, d):
    """Findings that name files of the corpus, some with evidence the files hold."""
    f = with_safe(V.findings(s, d))
    ext = V._pick(EXTENSIONS, F.col("finding_id") % 7)
    i = F.col("finding_id")
    loc = F.concat(F.lit("Unit"), (i % 50).cast("string"), F.lit("_"), i.cast("string"), F.lit("."), ext,
                   F.when(i % 11 == 0, "").otherwise(F.concat(F.lit(":"), (F.floor(i / 50) % 40 + 1).cast("string"))))
    return f.withColumn("location", loc).withColumn("evidence", F.when(i % 3 == 0, F.array(F.lit("return the value"))).when(
        i % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("evidence")))


def _contents(s, d):
    return files(s, d).select(base_name(F.col("file_name")).alias("file_key"), "content")


VIEWS["v_spoken"] = f"""
SELECT finding_id, category, severity, ev1, ev2, 'Unit' || (finding_id % 50) || '_' || finding_id || '.' || {pick(EXTENSIONS, 'finding_id % 7')} ||
  CASE WHEN finding_id % 11 = 0 THEN '' ELSE ':' || (finding_id // 50 % 40 + 1) END AS location,
  CASE WHEN finding_id % 11 <> 0 THEN finding_id // 50 % 40 + 1 END AS line,
  CASE WHEN finding_id % 3 = 0 THEN ['return the value'] WHEN finding_id % 13 = 0 THEN [] ELSE [ev1, ev2] END AS evidence,
  finding_id % 3 = 0 AS soft FROM v_cf"""
_keep = " ".join(f"WHEN contains(lower(category), '{w.lower()}') THEN severity IN ({', '.join(repr(x) for x in al)})" for w, al in K.EXPECTED_SEVERITIES)
VIEWS["v_checked0"] = f"""
SELECT s.*, c.file_key, c.code, c.n_lines, CASE {_keep} ELSE severity <> 'CRITICAL' END AS severity_fits
FROM (SELECT *, CASE WHEN regexp_matches(location, '\\.(cs|js|ts|py|java)') THEN split_part(location, ':', 1) ELSE '' END AS fk FROM v_spoken) s
LEFT JOIN (SELECT regexp_extract(file_name, '[^/]*$') AS file_key, len(string_split(content, chr(10))) AS n_lines,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '//.*$', ''), '/\\*.*?\\*/', '', 'g'))) AS code FROM v_files) c ON c.file_key = s.fk"""
# an evidence text is found whole, or by at least half of its words (rounded down, at least one)
VIEWS["v_checked"] = """
SELECT finding_id, fk AS file_key, severity_fits,
  code IS NOT NULL AND (line IS NULL OR line BETWEEN 1 AND n_lines) AS line_valid,
  code IS NOT NULL AND len(evidence) > 0 AND len(list_filter(evidence, lambda e: NOT (contains(code, lower(e)) OR
    len(list_filter(string_split(lower(e), ' '), lambda w: w <> '' AND contains(code, w))) >= greatest(1, len(string_split(e, ' ')) // 2)))) = 0 AS evidence_present,
  code IS NOT NULL AND line IS NOT NULL AND line NOT BETWEEN 1 AND n_lines AS failed, code IS NULL OR line IS NULL AS weak
FROM v_checked0"""
VIEWS["v_validated"] = """SELECT finding_id, file_key, line_valid, evidence_present, severity_fits,
 CASE WHEN failed THEN 'Failed' WHEN weak OR NOT line_valid OR NOT evidence_present OR NOT severity_fits THEN 'LowConfidence' ELSE 'Validated' END AS status FROM v_checked"""
register("validate_findings", lambda s, d: VD.validate_findings(_spoken(s, d), _contents(s, d)), q("SELECT * FROM v_validated"))
VIEWS["v_hit_ids"] = """
SELECT a.finding_id FROM v_cf a WHERE (severity = 'CRITICAL' AND EXISTS (SELECT 1 FROM v_cf b WHERE b.location = a.location AND b.severity = 'LOW'))
  OR (severity = 'LOW' AND EXISTS (SELECT 1 FROM v_cf b WHERE b.location = a.location AND b.severity = 'CRITICAL'))
UNION SELECT x.finding_id FROM v_ev x JOIN v_ev y ON x.e = y.e AND ((upper(x.category) LIKE '%SECURITY%' AND upper(y.category) LIKE '%SAFE%') OR (upper(x.category) LIKE '%SAFE%' AND upper(y.category) LIKE '%SECURITY%'))"""


def _status(s, d):
    checks = VD.validate_findings(_spoken(s, d), _contents(s, d))
    return VD.validation_status(checks, with_safe(V.findings(s, d))).select("finding_id", "status", "contradicted", "final_status")


register("validation_status", _status, q("""
SELECT finding_id, status, hit AS contradicted, CASE WHEN hit AND status = 'Validated' THEN 'LowConfidence' ELSE status END AS final_status
FROM (SELECT *, finding_id IN (SELECT finding_id FROM v_hit_ids) AS hit FROM v_validated)"""))
register("contradicted", lambda s, d: G.contradicted(with_safe(V.findings(s, d))), q("SELECT finding_id FROM v_hit_ids"))
VIEWS["v_clamped"] = "SELECT *, list_transform(parts, lambda p: CASE WHEN score IS NULL THEN 50 ELSE least(greatest(p, 0), 100) END) AS c FROM v_confidence"
register("normalise_confidence", lambda s, d: VD.normalise_confidence(V.confidence(s, d)).select("finding_id", "confidence", F.array_join("clamped", ",").alias("parts"), "level"), q("""
SELECT finding_id, confidence, array_to_string(c, ',') AS parts, CASE WHEN confidence >= 90 THEN 'High' WHEN confidence >= 60 THEN 'Medium' ELSE 'Low' END AS level FROM (
SELECT *, CASE WHEN score IS NULL THEN 50 WHEN least(greatest(score, 0), 100) = 0 THEN CAST(round_even(c[1] * 0.35::DOUBLE + c[2] * 0.35::DOUBLE + c[3] * 0.2::DOUBLE + c[4] * 0.1::DOUBLE, 0) AS BIGINT)
  ELSE least(greatest(score, 0), 100) END AS confidence FROM v_clamped)"""))


ERROR_TYPES = ["TimeoutException", "HttpRequestException", "TaskCanceledException", "InvalidOperationException", "ArgumentException",
               "UnauthorizedAccessException", "IOException"]
ERROR_MESSAGES = ["rate limit reached", "HTTP 429 returned", "operation timeout", "bad state"]


def _log(s, d):
    e = V.table(s, d, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("log_id"), V._pick(ERROR_TYPES, F.col("user_id") % 7).alias("error_type"), V._pick(ERROR_MESSAGES, F.col("event_id") % 4).alias("message"))


def _triage(col: int) -> str:
    out = []
    for rule in K.ERROR_RULES:
        cond = "TRUE" if rule[0] is None else f"error_type = '{rule[0]}'"
        if rule[1]:
            cond += f" AND regexp_matches(lower(message), '{'|'.join(rule[1])}')"
        out.append(f"WHEN {cond} THEN {lit(rule[col]) if isinstance(rule[col], str) else str(rule[col]).lower()}")
    return "CASE " + " ".join(out) + " END"


VIEWS["v_log"] = f"SELECT event_id AS log_id, {pick(ERROR_TYPES, 'user_id % 7')} AS error_type, {pick(ERROR_MESSAGES, 'event_id % 4')} AS message FROM events WHERE event_type = 'error'"
register("error_triage", lambda s, d: VD.error_triage(_log(s, d)), q(
    f"SELECT log_id, error_type, 'ERR-' || upper(substr(error_type, 1, 3)) || '-' || upper(substr(md5(error_type), 1, 8)) AS error_code, {_triage(2)} AS retryable, {_triage(3)} AS delay_seconds, {_triage(4)} AS remedy FROM v_log"))
register("partial_gate", lambda s, d: VD.partial_gate(V.analyses(s, d)), q("""
SELECT project, agents, succeeded, failed, succeeded >= 2 AS keep_partial, CASE WHEN failed = 0 THEN 'complete' WHEN succeeded >= 2 THEN 'partial' ELSE 'failed' END AS outcome
FROM (SELECT project, count(*) AS agents, count(*) FILTER (NOT is_error) AS succeeded, count(*) FILTER (is_error) AS failed FROM v_analyses GROUP BY project)"""))
