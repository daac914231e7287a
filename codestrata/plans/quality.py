"""Queries that judge findings: ground truth and repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import determinism as D, groundtruth as T
from ..session import cut_lineage
from ..sources import views as V
from .oracle import VIEWS, q
from .registry import register

RUNS = 10
_syn = " OR ".join(f"(a.c IN ('{k}', {', '.join(repr(w) for w in ws)}) AND b.c IN ('{k}', {', '.join(repr(w) for w in ws)}))" for k, ws in T.SYNONYMS.items())
_norm = "translate(lower(trim(category)), '_-', '  ')"
_sev = "list_position(['LOW','MEDIUM','HIGH','CRITICAL'], upper(severity))"
VIEWS["v_catpair"] = f"""
SELECT a.c AS fcat, b.c AS icat FROM (SELECT DISTINCT {_norm} AS c FROM v_findings) a, (SELECT DISTINCT {_norm} AS c FROM v_gt_issues) b
WHERE contains(a.c, b.c) OR contains(b.c, a.c) OR {_syn}"""
VIEWS["v_f"] = f"SELECT finding_id, agent, category, severity, location, {_norm} AS fcat, {_sev} AS fsev, CAST(regexp_extract(location, ':(\\d+)', 1) AS BIGINT) AS fline FROM v_findings"
VIEWS["v_i"] = f"SELECT *, {_norm} AS icat, {_sev} AS isev FROM v_gt_issues"
# every pair with a matching category (no other pair can reach the minimum of 70)
VIEWS["v_pairs"] = """
SELECT f.finding_id, i.issue_order, i.issue_id, abs(f.fsev - i.isev) <= 1 AS sev_ok,
  CASE WHEN i.line_number IS NOT NULL THEN abs(f.fline - i.line_number) <= 5 ELSE contains(lower(f.location), lower(i.location)) OR contains(lower(i.location), lower(f.location)) END AS loc_ok
FROM v_f f JOIN v_catpair p ON p.fcat = f.fcat JOIN v_i i ON i.icat = p.icat"""
VIEWS["v_cand"] = """
SELECT finding_id, CASE WHEN sev_ok AND loc_ok THEN 100.0::DOUBLE WHEN sev_ok THEN 80.0::DOUBLE ELSE 70.0::DOUBLE END AS confidence, count(*) AS n_issues, min(issue_order) AS first
FROM v_pairs WHERE sev_ok OR loc_ok GROUP BY 1, 2"""
VIEWS["v_match"] = """
SELECT f.finding_id, f.agent, f.category AS f_category, f.severity AS f_severity, c.confidence, i.issue_id, i.category AS i_category, i.severity AS i_severity, i.is_mandatory, i.expected_agent,
  c.confidence IS NOT NULL AS is_tp
FROM v_findings f LEFT JOIN (SELECT * FROM v_cand QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY confidence DESC) = 1) c ON c.finding_id = f.finding_id
LEFT JOIN v_gt_issues i ON i.issue_order = c.first"""
VIEWS["v_missed"] = "SELECT * FROM v_gt_issues WHERE is_mandatory AND issue_id NOT IN (SELECT issue_id FROM v_match WHERE is_tp)"


def _verdicts(s, d):
    return T.with_verdict(T.gt_match(V.findings(s, d), V.gt_issues(s, d)))


def judged(fn):
    """Verdicts are read several times, so they are written once."""
    return lambda s, d: fn(cut_lineage(_verdicts(s, d)), V.gt_issues(s, d))


register("gt_candidates", lambda s, d: T.gt_candidates(V.findings(s, d), V.gt_issues(s, d)), q("SELECT finding_id, confidence, n_issues FROM v_cand"))
register("gt_match", lambda s, d: _verdicts(s, d).where("is_tp").select("finding_id", "issue_id", "confidence", "match_type"),
         q("SELECT finding_id, issue_id, confidence, CASE WHEN confidence = 100 THEN 'Exact' ELSE 'Partial' END AS match_type FROM v_match WHERE is_tp"))
register("gt_classify", judged(T.gt_classify), q("""
SELECT CASE WHEN is_tp THEN 'true positive' ELSE 'false positive' END AS verdict, CAST(finding_id AS VARCHAR) AS ref, coalesce(issue_id, '') AS issue_id FROM v_match
UNION ALL SELECT 'false negative', '', issue_id FROM v_missed"""))


def metrics_sql(source: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""SELECT {k}tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) * 100.0 ELSE 0 END, 4) AS accuracy,
  CASE WHEN f1 >= 85 THEN 'EXCELLENT' WHEN f1 >= 75 THEN 'GOOD' WHEN f1 >= 65 THEN 'MODERATE' ELSE 'LOW' END AS quality
FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0 END AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) * 100 ELSE 0 END AS p,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) * 100 ELSE 0 END AS r FROM ({source})))"""


register("gt_metrics", judged(T.gt_metrics), q(metrics_sql(
    "SELECT count(*) FILTER (is_tp) AS tp, count(*) FILTER (NOT is_tp) AS fp, (SELECT count(*) FROM v_missed) AS fn FROM v_match")))
register("gt_metrics_by_agent", judged(T.gt_metrics_by_agent), q(metrics_sql("""
SELECT a.agent, a.tp, a.fp, (SELECT count(*) FROM v_gt_issues i WHERE i.is_mandatory AND (i.expected_agent IS NULL OR i.expected_agent = a.agent)
  AND NOT EXISTS (SELECT 1 FROM v_match m WHERE m.is_tp AND m.agent = a.agent AND m.issue_id = i.issue_id)) AS fn
FROM (SELECT agent, count(*) FILTER (is_tp) AS tp, count(*) FILTER (NOT is_tp) AS fp FROM v_match GROUP BY agent) a""", "agent")))
for _c in ["category", "severity"]:
    VIEWS[f"v_by_{_c}"] = f"""
SELECT {_c}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
SELECT CASE WHEN is_tp THEN i_{_c} ELSE f_{_c} END AS {_c}, CAST(is_tp AS INTEGER) AS tp, CAST(NOT is_tp AS INTEGER) AS fp, 0 AS fn FROM v_match
UNION ALL SELECT {_c}, 0, 0, 1 FROM v_missed) GROUP BY {_c}"""
register("gt_metrics_by_category", judged(T.gt_metrics_by_category), q(metrics_sql("SELECT * FROM v_by_category", "category")))
register("gt_metrics_by_severity", judged(T.gt_metrics_by_severity), q(metrics_sql("SELECT * FROM v_by_severity", "severity")))
register("gt_top_errors", judged(T.gt_top_errors), q("""
SELECT * FROM (SELECT 'false positive' AS kind, CAST(finding_id AS VARCHAR) AS ref, greatest((SELECT count(*) FROM v_match WHERE NOT is_tp) - 5, 0) AS more
  FROM v_match WHERE NOT is_tp ORDER BY finding_id LIMIT 5) UNION ALL
SELECT * FROM (SELECT 'false negative', issue_id, greatest((SELECT count(*) FROM v_missed) - 5, 0) FROM v_missed ORDER BY issue_order LIMIT 5)"""))

# --- repeated runs -------------------------------------------------------------------
VIEWS["v_keyed"] = """
SELECT *, lower(category) || '|' || regexp_replace(regexp_replace(lower(location), ':\\d+', ':*', 'g'), 'line\\s+\\d+', 'line *', 'g') AS finding_key FROM v_run_findings"""
register("finding_key", lambda s, d: D.with_key(V.run_findings(s, d)).select("finding_id", "finding_key"), q("SELECT finding_id, finding_key FROM v_keyed"))
register("run_hash", lambda s, d: D.run_hash(V.run_findings(s, d)), q("""
SELECT run_number, count(*) AS findings, substr(to_base64(unhex(sha256(count(*) || ':' || sum(CAST(CAST('0x' || substr(md5(pos || '|' || t), 1, 15) AS BIGINT) AS HUGEINT))))), 1, 16) AS run_hash
FROM (SELECT run_number, category || ':' || severity || ':' || location AS t, row_number() OVER (PARTITION BY run_number ORDER BY finding_id) AS pos FROM v_run_findings)
GROUP BY run_number"""))


def cons_sql(by: str = "") -> str:
    return f"""SELECT finding_key, {by} count(*) AS appearances, count(DISTINCT run_number) AS runs_seen, arg_min(category, run_number * 1000000000 + finding_id) AS category,
  count(*) / 10 * 100.0::DOUBLE AS rate, count(*) / 10 * 100.0::DOUBLE >= 80 AS is_consistent, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities, count(DISTINCT severity) = 1 AS one_severity
FROM v_keyed GROUP BY finding_key{', ' + by.rstrip(', ') if by else ''}"""


VIEWS["v_cons"] = cons_sql()
VIEWS["v_cons_agent"] = cons_sql("agent, ")
register("run_consistency", lambda s, d: D.run_consistency(V.run_findings(s, d), RUNS).withColumn("rate", F.round("rate", 4)),
         q("SELECT * REPLACE (round(rate, 4) AS rate) FROM v_cons"))
register("run_score", lambda s, d: D.run_score(D.run_consistency(V.run_findings(s, d), RUNS)), q("""
SELECT keys, round(s, 4) AS score, CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 80 THEN 'Good' WHEN s >= 70 THEN 'Moderate' WHEN s >= 60 THEN 'Fair' ELSE 'Poor' END AS level
FROM (SELECT count(*) AS keys, avg(rate) AS s FROM v_cons)"""))
_by = ("SELECT {0}, c AS consistent, i AS inconsistent, round(c / (c + i) * 100.0::DOUBLE, 4) AS score FROM (SELECT {0}, count(*) FILTER (is_consistent) AS c, "
       "count(*) FILTER (NOT is_consistent) AS i FROM {1} GROUP BY {0}) WHERE c > 0")
register("run_by_category", lambda s, d: D.run_by(D.run_consistency(V.run_findings(s, d), RUNS), "category"), q(_by.format("category", "v_cons")))
register("run_by_agent", lambda s, d: D.run_by(D.run_consistency(V.run_findings(s, d), RUNS, by=["agent"]), "agent"), q(_by.format("agent", "v_cons_agent")))
register("run_stats", lambda s, d: D.run_stats(V.run_findings(s, d), D.run_consistency(V.run_findings(s, d), RUNS), RUNS), q("""
SELECT * FROM (SELECT count(*) AS keys, count(*) FILTER (is_consistent AND rate = 100) AS "full", count(*) FILTER (is_consistent AND rate >= 80) AS high,
  count(*) FILTER (is_consistent AND rate >= 50 AND rate < 80) AS moderate, count(*) FILTER (rate >= 50 AND rate < 80) AS moderate_band, count(*) FILTER (NOT is_consistent AND rate < 50) AS poor FROM v_cons),
 (SELECT round(avg(n), 4) AS avg_findings, min(n) AS min_findings, max(n) AS max_findings, round(stddev_pop(n), 4) AS sd_findings FROM (SELECT run_number, count(*) AS n FROM v_run_findings GROUP BY run_number))"""))
register("run_similarity", lambda s, d: D.run_similarity(V.run_findings(s, d)), q("""
SELECT run_a, run_b, common, sa + sb - common AS all_keys, round(common / (sa + sb - common) * 100.0::DOUBLE, 4) AS similarity FROM (
SELECT a.run_number AS run_a, b.run_number AS run_b, a.n AS sa, b.n AS sb, (SELECT count(*) FROM (SELECT finding_key FROM v_keyed x WHERE x.run_number = a.run_number
  INTERSECT SELECT finding_key FROM v_keyed y WHERE y.run_number = b.run_number)) AS common
FROM (SELECT run_number, count(DISTINCT finding_key) AS n FROM v_keyed GROUP BY run_number) a JOIN (SELECT run_number, count(DISTINCT finding_key) AS n FROM v_keyed GROUP BY run_number) b
ON a.run_number < b.run_number)"""))
