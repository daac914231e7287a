"""Queries that roll files up to modules, folders and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data.advice import ADVICE, STEPS
from ..data import rules as R
from ..data.bands import BANDS
from ..functions.text import detect_language
from ..operators import measures as M, rollup as U, rulescan as RS, symbols as SY
from ..sources import views as V
from .corpus import files
from .oracle import VIEWS, has, lit, q
from .registry import register


def counts(s, d, extra=()):
    return SY.file_counts(files(s, d), ["project", "module", *extra])


def scored(s, d):
    return counts(s, d).withColumn("score", M.file_complexity(F.col("classes"), F.col("methods"), F.col("imports")))


# --- 2.3 texts ------------------------------------------------------------------
_rule_order = ", ".join(f"('{r.rule_id}', {i})" for i, r in enumerate(R.ALL_RULES))
VIEWS["v_hit_list"] = f"""
SELECT file_name, family, '[' || severity || '] ' || h.rule_id AS txt, row_number() OVER (PARTITION BY file_name, family ORDER BY o.i) AS rn,
  count(*) OVER (PARTITION BY file_name, family) AS n FROM v_hits h JOIN (VALUES {_rule_order}) o(rule_id, i) ON o.rule_id = h.rule_id"""
VIEWS["v_hit_text"] = """SELECT file_name, family, max(n) AS n, string_agg(txt, '; ' ORDER BY rn) FILTER (rn <= 5) || CASE WHEN max(n) > 5 THEN '; ...' ELSE '' END AS txt
FROM v_hit_list GROUP BY file_name, family"""
VIEWS["v_sig_text"] = """
SELECT file_name, kind, max(n) AS n, string_agg(signature, ' | ' ORDER BY rn) FILTER (rn <= CASE kind WHEN 'class' THEN 6 ELSE 10 END) ||
  CASE WHEN max(n) > CASE kind WHEN 'class' THEN 6 ELSE 10 END THEN ' | ...' ELSE '' END AS txt
FROM (SELECT *, row_number() OVER (PARTITION BY file_name, kind ORDER BY line) AS rn, count(*) OVER (PARTITION BY file_name, kind) AS n FROM v_signatures) GROUP BY file_name, kind"""
VIEWS["v_imp_text"] = """
SELECT file_name, max(n) AS n, string_agg(module, ', ' ORDER BY rn) FILTER (rn <= 8) || CASE WHEN max(n) > 8 THEN ', ...' ELSE '' END AS txt
FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY line) AS rn, count(*) OVER (PARTITION BY file_name) AS n FROM v_imports) GROUP BY file_name"""
VIEWS["v_summary"] = """
SELECT f.file_name, concat_ws(chr(10), 'File: ' || f.file_name || ' (' || f.size || ' bytes) | Language: ' || f.language,
  'Imports/Dependencies: ' || i.txt, CASE WHEN c.container <> '' THEN 'Namespaces/Modules: ' || c.container END,
  'Classes/Types: ' || sc.txt, 'Methods/Functions: ' || sm.txt,
  'Security Risks (' || h1.n || '): ' || h1.txt, 'Performance Issues (' || h2.n || '): ' || h2.txt, 'Architecture Concerns (' || h3.n || '): ' || h3.txt,
  CASE WHEN h1.n IS NULL AND h2.n IS NULL AND h3.n IS NULL THEN 'Pattern Analysis: No critical patterns detected.' END,
  'Complexity: CC=' || y.cyclomatic || ', LOC=' || y.loc || ', Classes=' || coalesce(sc.n, 0) || ', Methods=' || coalesce(sm.n, 0)) AS summary,
  coalesce(h1.n, 0) + coalesce(h2.n, 0) + coalesce(h3.n, 0) AS hits
FROM v_files f JOIN v_container c ON c.file_name = f.file_name JOIN v_cyclo y ON y.file_name = f.file_name
LEFT JOIN v_imp_text i ON i.file_name = f.file_name
LEFT JOIN v_sig_text sc ON sc.file_name = f.file_name AND sc.kind = 'class' LEFT JOIN v_sig_text sm ON sm.file_name = f.file_name AND sm.kind = 'method'
LEFT JOIN v_hit_text h1 ON h1.file_name = f.file_name AND h1.family = 'security' LEFT JOIN v_hit_text h2 ON h2.file_name = f.file_name AND h2.family = 'performance'
LEFT JOIN v_hit_text h3 ON h3.file_name = f.file_name AND h3.family = 'architecture'"""
register("file_summary", lambda s, d: M.file_summary(files(s, d)), q("SELECT file_name, summary FROM v_summary"))

VIEWS["v_ns"] = "SELECT DISTINCT project, unnest(regexp_extract_all(content, 'namespace\\s+([^\\s{;]+)', 1)) AS name FROM v_files WHERE ext = 'cs'"
VIEWS["v_dep0"] = "SELECT project, trim(unnest(regexp_extract_all(content, 'using\\s+([^;]+);', 1))) AS name FROM v_files WHERE ext = 'cs'"
VIEWS["v_dep"] = "SELECT DISTINCT project, name FROM v_dep0 WHERE NOT starts_with(name, 'System') AND contains(name, '.')"
register("project_metadata", lambda s, d: M.project_metadata(files(s, d)), q("""
SELECT t.project, '' AS solution, coalesce(n.x, '') AS namespaces, coalesce(e.x, '') AS dependencies, t.total_lines
FROM (SELECT project, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS total_lines FROM v_files WHERE ext = 'cs' GROUP BY project) t
LEFT JOIN (SELECT project, string_agg(name, ', ' ORDER BY name) AS x FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY name) AS rn FROM v_ns) WHERE rn <= 10 GROUP BY project) n ON n.project = t.project
LEFT JOIN (SELECT project, string_agg(name, ', ' ORDER BY name) AS x FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY name) AS rn FROM v_dep) WHERE rn <= 20 GROUP BY project) e ON e.project = t.project"""))

# --- 2.6 ---------------------------------------------------------------------------
VIEWS["v_pc"] = """SELECT c.*, f.project, f.module, f.size, least(greatest(classes * 10 + methods * 2 + imports, 0), 100) AS score
FROM v_counts c JOIN v_files f ON f.file_name = c.file_name"""
_s = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["classes", "methods", "properties", "imports", "loc"])
register("project_totals", lambda s, d: U.project_totals(counts(s, d)),
         q(f"SELECT coalesce(CAST(project AS VARCHAR), 'all') AS project, coalesce(module, 'all') AS module, count(*) AS files, {_s} FROM v_pc GROUP BY ROLLUP(project, module)"))
VIEWS["v_project"] = f"""
SELECT *, CASE WHEN overall < 30 THEN 'LOW' WHEN overall < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM (
SELECT *, least(100, CAST(trunc(greatest(0, sum_score / files + least(files * 1.5, 20) + CASE WHEN classes > 0 THEN methods / classes ELSE 0 END * 2)) AS BIGINT)) AS overall
FROM (SELECT project, count(*) AS files, {_s}, CAST(sum(score) AS BIGINT) AS sum_score FROM v_pc GROUP BY project))"""
register("project_complexity", lambda s, d: U.per_project(counts(s, d)).select("project", "files", "overall"),
         q("SELECT project, files, overall FROM v_project"))
register("risk_level", lambda s, d: scored(s, d).select("file_name", "score", U.risk_level(F.col("score")).alias("risk")),
         q("SELECT file_name, score, CASE WHEN score < 30 THEN 'LOW' WHEN score < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM v_pc"))
register("risk_distribution", lambda s, d: U.risk_distribution(scored(s, d)),
         q("""SELECT *, round(low * 100.0 / files, 4) AS low_pct, round(medium * 100.0 / files, 4) AS medium_pct, round(high * 100.0 / files, 4) AS high_pct FROM (
SELECT project, count(*) AS files, count(*) FILTER (score < 40) AS low, count(*) FILTER (score >= 40 AND score < 70) AS medium, count(*) FILTER (score >= 70) AS high
FROM v_pc GROUP BY project)"""))
register("quality_split", lambda s, d: U.quality_split(SY.file_counts(files(s, d), ["project", "size"]).withColumn("score", M.file_complexity(
    F.col("classes"), F.col("methods"), F.col("imports"))).withColumn("status", F.when(F.col("size") > 8000, "Error").otherwise("Completed"))),
    q("SELECT project, count(*) FILTER (size <= 8000) AS completed, count(*) FILTER (size > 8000) AS failed, "
      "round(coalesce(avg(score) FILTER (size <= 8000), 0), 4) AS avg_score FROM v_pc GROUP BY project"))
register("top_files", lambda s, d: U.top_files(scored(s, d)).select("file_name", "score"),
         q("SELECT file_name, score FROM v_pc ORDER BY score DESC, file_name LIMIT 10"))


def meta(s, d):
    hits = RS.hit_counts(files(s, d), extra=["content", "project"])
    return M.cyclomatic(hits, ["project", "security_hits", "performance_hits", "architecture_hits"])


register("preprocess_summary", lambda s, d: U.preprocess_summary(meta(s, d)), q("""
SELECT *, CASE WHEN security > 0 THEN 'High' WHEN performance + architecture > 3 THEN 'Medium' ELSE 'Low' END AS risk FROM (
SELECT f.project, count(*) AS files, CAST(sum(cyclomatic) AS BIGINT) AS complexity, CAST(sum(security_hits) AS BIGINT) AS security,
  CAST(sum(performance_hits) AS BIGINT) AS performance, CAST(sum(architecture_hits) AS BIGINT) AS architecture
FROM v_meta m JOIN v_files f ON f.file_name = m.file_name GROUP BY f.project)"""))

VIEWS["v_issues"] = """
SELECT file_name, 'ObsoleteApi' AS pattern_type, 'High' AS severity, line FROM v_api UNION ALL
SELECT file_name, 'MagicNumber', 'Medium', line FROM v_magic UNION ALL SELECT file_name, 'EmptyCatchBlock', 'High', line FROM v_catch UNION ALL
SELECT file_name, 'GlobalState', severity, coalesce(line, 0) FROM v_global_state UNION ALL
SELECT file_name, 'GodObject', 'High', line FROM v_members WHERE language = 'csharp' AND (methods >= 20 OR methods + properties + fields >= 30) UNION ALL
SELECT file_name, 'DeadCode', 'Low', line FROM v_dead WHERE unused UNION ALL SELECT file_name, 'DeadCode', 'Low', line FROM v_dead WHERE marked UNION ALL
SELECT file_name, 'CyclicDependency', 'High', 0 FROM v_coupling_file UNION ALL SELECT file_name, 'CyclicDependency', 'Medium', 0 FROM v_coupling_class WHERE n > 10"""
VIEWS["v_issue_types"] = "SELECT file_name, pattern_type, count(*) AS n FROM v_issues GROUP BY ALL"
VIEWS["v_legacy"] = """
SELECT i.file_name, count(*) AS issues, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
  count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low,
  bool_or(pattern_type = 'GlobalState') AS has_global_state, bool_or(pattern_type = 'ObsoleteApi') AS uses_obsolete_apis, any_value(t.top_types) AS top_types
FROM v_issues i JOIN (SELECT file_name, string_agg(pattern_type || ' (' || n || ')', ', ' ORDER BY n DESC, pattern_type) AS top_types
  FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY n DESC, pattern_type) AS rn FROM v_issue_types) WHERE rn <= 5 GROUP BY file_name) t
ON t.file_name = i.file_name GROUP BY i.file_name"""
register("legacy_rollup", lambda s, d: U.legacy_rollup(U.legacy_issues(files(s, d))), q("SELECT * FROM v_legacy"))
register("legacy_corpus", lambda s, d: U.legacy_corpus(U.legacy_rollup(U.legacy_issues(files(s, d))), M.legacy_age(files(s, d), V.AS_OF)), q("""
SELECT 'very old files' AS indicator, count(*) FILTER (is_very_old) AS n FROM v_age UNION ALL SELECT 'ancient framework files', count(*) FILTER (is_ancient) FROM v_age
UNION ALL SELECT 'files', count(*) FROM v_age UNION ALL SELECT 'global state files', count(*) FILTER (has_global_state) FROM v_legacy
UNION ALL SELECT 'obsolete api files', count(*) FILTER (uses_obsolete_apis) FROM v_legacy UNION ALL SELECT 'issues', CAST(sum(issues) AS BIGINT) FROM v_legacy"""))
register("legacy_browse", lambda s, d: U.legacy_browse(U.legacy_issues(files(s, d)), ["Critical", "High"]),
         q("SELECT file_name, pattern_type, severity, line, CASE severity WHEN 'Critical' THEN 4 ELSE 3 END AS rank FROM v_issues WHERE severity IN ('Critical', 'High')"))

_known = " ".join(f"WHEN contains(lower(f.file_name), '/{k.lower()}/') THEN '{k}'" for k in U.KNOWN_FOLDERS)
VIEWS["v_module"] = f"""
SELECT f.file_name, coalesce(nullif(regexp_extract(container, '[^.]*$'), ''), CASE {_known} END, nullif(split_part(f.file_name, '/', -2), ''), 'Other') AS module
FROM v_files f JOIN v_container c ON c.file_name = f.file_name"""


def modules(s, d, *extra):
    f = files(s, d)
    return f.select("file_name", U.module_of(F.col("file_name"), SY.container_of()).alias("module"), *extra)


register("module_of", lambda s, d: modules(s, d), q("SELECT file_name, module FROM v_module"))
VIEWS["v_packed"] = """
SELECT file_name, module, module_size, position, position // 10 AS batch FROM (
SELECT *, row_number() OVER (ORDER BY module_size DESC, module, file_name) - 1 AS position FROM (
SELECT *, count(*) OVER (PARTITION BY module) AS module_size FROM v_module))"""
register("pack_batches", lambda s, d: U.pack_batches(modules(s, d)), q("SELECT * FROM v_packed"))
register("pack_report", lambda s, d: U.pack_report(U.pack_batches(modules(s, d))),
         q("SELECT count(*) AS files, count(DISTINCT batch) AS batches, round_even((1.0::DOUBLE - count(DISTINCT batch) / count(*)) * 100, 1) AS reduction_pct FROM v_packed"))


def _payload(s, d):
    c = SY.file_counts(files(s, d), ["content"])
    return U.batch_payload(U.pack_batches(modules(s, d)), c)


VIEWS["v_batch_n"] = "SELECT batch, count(*) AS n, min(position) AS first FROM v_packed GROUP BY batch"
register("batch_payload", _payload, q("""
SELECT batch, count(*) AS n_files, string_agg('FILE ' || (position - first + 1) || ': ' || file_name || chr(10) || 'Metrics: ' || classes || ' classes, ' || methods || ' methods, ' || properties
  || ' properties' || chr(10) || 'Code:' || chr(10) || CASE WHEN length(content) > lim THEN substr(content, 1, lim) || '...' ELSE content END, chr(10) || '---' || chr(10) ORDER BY position) AS payload
FROM (SELECT p.batch, p.position, b.first, p.file_name, c.classes, c.methods, c.properties, f.content,
  CASE WHEN b.n > 3 THEN greatest(400, 1200 // (b.n // 2)) ELSE 1200 END AS lim
  FROM v_packed p JOIN v_batch_n b ON b.batch = p.batch JOIN v_counts c ON c.file_name = p.file_name JOIN v_files f ON f.file_name = p.file_name) GROUP BY batch"""))
register("batch_eta", lambda s, d: U.batch_eta(V.requests(s, d)), q("""
SELECT request_id, client, k AS batch_number, n AS batches, CASE WHEN k > 1 THEN round(CAST(spent AS DOUBLE) / (k - 1) * (n - k), 4) END AS eta_ms FROM (
SELECT request_id, client, row_number() OVER w AS k, count(*) OVER (PARTITION BY client) AS n,
  sum(duration_ms) OVER (PARTITION BY client ORDER BY ts_ms, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent
FROM v_requests WINDOW w AS (PARTITION BY client ORDER BY ts_ms, request_id))"""))
register("throughput", lambda s, d: U.throughput(V.requests(s, d)), q("""
SELECT operation, files, round(busy / files, 4) AS ms_per_file, round(CASE WHEN elapsed > 0 AND busy > 0 THEN busy / elapsed ELSE 1 END, 4) AS speed_up,
  round(CASE WHEN elapsed > 0 THEN files * 1000.0::DOUBLE / elapsed ELSE 0 END, 4) AS files_per_sec
FROM (SELECT operation, count(*) AS files, CAST(sum(duration_ms) AS BIGINT) AS busy, max(ts_ms + duration_ms) - min(ts_ms) AS elapsed FROM v_requests GROUP BY operation)"""))


def _case(col: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({col}), '{'|'.join(ws)}') THEN {lit(label)}" for ws, label in table) + f" ELSE {lit(default)} END"


VIEWS["v_folders"] = f"""
SELECT project, folder, n_files, {_case('folder', U.FOLDER_PURPOSE, 'Application Logic Components')} AS purpose, {_case('folder', U.FOLDER_ROLE, 'Application Layer')} AS role,
  key_classes, least(100, n_files * 5 + CASE WHEN n_files > 10 THEN 20 ELSE 0 END) AS score
FROM (SELECT project, folder, count(*) AS n_files, string_agg(regexp_extract(file_name, '([^/]*)\\.[^.]*$', 1), ', ' ORDER BY rn) FILTER (rn <= 5) AS key_classes
FROM (SELECT project, regexp_extract(file_name, '^(.*)/[^/]*$', 1) AS folder, file_name,
  row_number() OVER (PARTITION BY project, regexp_extract(file_name, '^(.*)/[^/]*$', 1) ORDER BY file_name) AS rn FROM v_files WHERE ext = 'cs') GROUP BY project, folder)"""
register("folder_analysis", lambda s, d: U.folder_analysis(files(s, d)), q("SELECT * FROM v_folders"))
register("project_type", lambda s, d: U.project_type(files(s, d)), q("""
SELECT project, CASE WHEN bool_or(file_name LIKE '%.sln') THEN 'Visual Studio Solution' WHEN bool_or(file_name LIKE '%.csproj') THEN '.NET Project'
  WHEN count(*) FILTER (ext = 'cs') > 10 THEN 'Large Source Code Project' ELSE 'Source Code Files' END AS project_type FROM v_files GROUP BY project"""))


def _any(col: str, words) -> str:
    return f"bool_or(regexp_matches(lower({col}), '{'|'.join(words)}'))"


_lay = ", ".join(f"CASE WHEN {_any('folder', ws)} THEN {lit(n)} END" for n, ws in U.LAYERS)
_pat = ", ".join(f"CASE WHEN {_any('file_name', ws)} THEN {lit(n)} END" for n, ws in U.DESIGN_PATTERNS)
VIEWS["v_arch0"] = f"""
SELECT f.project, CASE WHEN c AND s AND r THEN 'Layered Architecture (MVC/Clean Architecture)' WHEN c AND s THEN 'Service-Oriented Architecture'
  WHEN m AND s THEN 'Domain-Driven Design' ELSE 'Monolithic Architecture' END AS pattern,
  coalesce(nullif(layers, ''), 'Single Layer Architecture') AS layers,
  CASE WHEN roles >= 4 THEN 'Excellent separation of concerns with clear architectural layers' WHEN roles >= 3 THEN 'Good separation with distinct business and data layers'
    WHEN roles >= 2 THEN 'Basic separation between presentation and logic' ELSE 'Poor separation - mixed concerns across components' END AS separation,
  coalesce(nullif(pats, ''), 'No clear design patterns detected') AS design_patterns,
  CASE WHEN tests >= 2 THEN 'Good test coverage with multiple test projects' WHEN tests >= 1 THEN 'Basic test coverage detected' ELSE 'No test projects detected - testing strategy needed' END AS test_coverage
FROM (SELECT project, {_any('folder', ['controller'])} AS c, {_any('folder', ['service'])} AS s, {_any('folder', ['repository'])} AS r, {_any('folder', ['model'])} AS m,
  concat_ws(', ', {_lay}) AS layers, count(DISTINCT role) AS roles, count(DISTINCT CASE WHEN contains(lower(folder), 'test') THEN folder END) AS tests FROM v_folders GROUP BY project) f
LEFT JOIN (SELECT project, concat_ws(', ', {_pat}) AS pats FROM v_files GROUP BY project) p ON p.project = f.project"""
VIEWS["v_arch"] = """SELECT *, least(100, CASE WHEN contains(separation, 'Poor') THEN 30 WHEN contains(separation, 'Basic') THEN 15 ELSE 0 END
 + CASE WHEN contains(pattern, 'Monolithic') THEN 20 ELSE 0 END + CASE WHEN contains(design_patterns, 'No clear') THEN 25 ELSE 0 END
 + CASE WHEN contains(test_coverage, 'No test') THEN 25 ELSE 0 END) AS debt FROM v_arch0"""


def arch(s, d):
    return U.architecture_assess(U.folder_analysis(files(s, d)), files(s, d))


register("architecture_assess", arch, q("SELECT * FROM v_arch"))
VIEWS["v_biz"] = """
SELECT project, debt, value, impact_risk,
  CASE WHEN debt < 30 THEN 'Low maintenance overhead with good architectural practices' WHEN debt < 60 THEN 'Moderate maintenance overhead requiring structured approach'
    ELSE 'High maintenance overhead with significant refactoring needs' END AS overhead, critical_areas,
  CASE WHEN impact_risk = 'LOW' AND files < 10 THEN 'Standard agile development with code review practices' WHEN impact_risk = 'LOW' THEN 'Structured development with architectural guidance'
    WHEN impact_risk = 'MEDIUM' THEN 'Phased modernization with risk mitigation strategies' ELSE 'Comprehensive modernization program with dedicated architecture team' END AS approach,
  CASE WHEN impact_risk = 'HIGH' AND value > 100000 THEN 'CRITICAL - Immediate executive attention required' WHEN impact_risk = 'HIGH' THEN 'HIGH - Significant business risk requiring prompt action'
    WHEN impact_risk = 'MEDIUM' AND value > 50000 THEN 'MEDIUM - Strategic investment opportunity' ELSE 'LOW - Include in regular development planning cycle' END AS priority
FROM (SELECT p.project, p.files, a.debt, round(least(1000000, loc * 0.10::DOUBLE * ((sum_score // files) / 100 + 0.5)), 4) AS value,
  CASE WHEN (sum_score // files + a.debt) // 2 < 30 THEN 'LOW' WHEN (sum_score // files + a.debt) // 2 < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS impact_risk,
  coalesce(c.x, '') AS critical_areas
FROM v_project p JOIN v_arch a ON a.project = p.project
LEFT JOIN (SELECT project, string_agg(folder, ', ' ORDER BY folder) AS x FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY folder) AS rn
  FROM v_folders WHERE score > 60 OR contains(role, 'Business')) WHERE rn <= 5 GROUP BY project) c ON c.project = p.project)"""


def impact(s, d):
    return U.business_impact(U.per_project(counts(s, d)), arch(s, d), U.folder_analysis(files(s, d)))


register("business_impact", impact, q("SELECT * FROM v_biz"))
register("business_metrics", lambda s, d: U.business_metrics(U.per_project(counts(s, d))), q("""
SELECT project, risk, round(h, 4) AS hours_saved, comp AS compliance_avoidance, project_size, timeline, approach, mitigation, round(h * 125, 4) AS savings, round(h * 125 + comp, 4) AS roi
FROM (SELECT project, risk, methods * 0.5::DOUBLE * (overall / 100 + 0.5) AS h, CASE risk WHEN 'HIGH' THEN 15000 WHEN 'MEDIUM' THEN 8000 WHEN 'LOW' THEN 3000 ELSE 1000 END AS comp,
  CASE WHEN files < 5 AND classes < 10 THEN 'Small Project' WHEN files < 15 AND classes < 50 THEN 'Medium Project' WHEN files < 30 AND classes < 150 THEN 'Large Project' ELSE 'Enterprise Project' END AS project_size,
  CASE WHEN overall < 30 THEN '2-4 weeks' WHEN overall < 50 THEN '4-8 weeks' WHEN overall < 60 THEN '8-12 weeks' ELSE '12+ weeks' END AS timeline,
  CASE WHEN overall < 30 THEN 'Agile development with standard practices' WHEN overall < 50 THEN 'Structured approach with experienced team'
    WHEN overall < 70 THEN 'Phased migration with risk mitigation' ELSE 'Enterprise methodology with dedicated team' END AS approach,
  CASE risk WHEN 'HIGH' THEN 'Dedicated migration team with senior architect oversight required' WHEN 'MEDIUM' THEN 'Experienced development team with structured approach recommended'
    ELSE 'Standard development practices with code review sufficient' END AS mitigation FROM v_project)"""))
register("manual_hours", lambda s, d: U.manual_hours(U.per_project(counts(s, d))),
         q("SELECT project, h AS hours, h * 125 AS cost FROM (SELECT project, CAST(trunc(classes * 2 + methods * 0.25 + imports * 0.5) AS BIGINT) AS h FROM v_project)"))

_bands = ", ".join(f"({lit(m)}, {'NULL' if lo is None else float(lo)}, {'NULL' if hi is None else float(hi)}, {lit(label)}, {r})" for m, lo, hi, label, r in BANDS)
VIEWS["v_bands"] = f"SELECT * FROM (VALUES {_bands}) b(measure, lo, hi, label, rank)"
_by = {"overall": ["risk level", "risk statistics", "complexity label", "status text", "maintenance level", "migration timeline", "resource requirements", "financial impact", "executive timeline"],
       "least((classes * 3 + methods + imports * 2) // 2, 100)": ["cost estimate", "roi timeline", "complexity risk", "resource risk", "timeline risk"],
       "files": ["file count"], "classes": ["class count", "scale risk", "modernization roi"], "methods": ["method count", "business impact", "operational risk"],
       "imports": ["dependency risk"], "imports + methods // greatest(classes, 1)": ["technical debt"], "classes * methods": ["migration complexity"], "classes * 2 + methods": ["strategic priority"]}
VIEWS["v_measures"] = " UNION ALL ".join(f"SELECT project, '{m}' AS measure, CAST({x} AS DOUBLE) AS value FROM v_project" for x, ms in _by.items() for m in ms)
register("band_lookup", lambda s, d: U.band_lookup(U.project_measures(U.per_project(counts(s, d))), U.bands_table(s)),
         q("SELECT m.measure, m.project, m.value, b.label, CAST(b.rank AS BIGINT) AS rank FROM v_measures m JOIN v_bands b ON b.measure = m.measure "
           "AND (b.lo IS NULL OR m.value >= b.lo) AND (b.hi IS NULL OR m.value < b.hi)"))


def _recommend(s, d):
    p = U.per_project(counts(s, d))
    out = None
    for kind in ["general", "security", "performance"]:
        one = U.recommend_project(p, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


_adv_rows = ", ".join(f"({i}, '{c}', {lit(t)})" for i, (c, t) in enumerate(ADVICE))
register("recommend_project", _recommend, q(f"""
SELECT project, rank - 1 AS rank, advice, kind FROM (SELECT p.project, k.kind, a.t AS advice, row_number() OVER (PARTITION BY p.project, k.kind ORDER BY a.i) AS rank
FROM v_project p, (VALUES ('general'), ('security'), ('performance')) k(kind), (VALUES {_adv_rows}) a(i, c, t)
WHERE CASE a.c WHEN 'high' THEN overall > 70 WHEN 'mid' THEN overall > 40 AND overall <= 70 WHEN 'low' THEN overall <= 40 WHEN 'large' THEN files > 25
  WHEN 'ratio' THEN classes > 0 AND methods / classes > 8 ELSE a.c = k.kind END) WHERE rank <= 6"""))
_step_rows = ", ".join(f"({i}, '{c}', {lit(t)})" for i, (c, t) in enumerate(STEPS))
register("next_steps", lambda s, d: U.next_steps(impact(s, d), arch(s, d)), q(f"""
SELECT project, rank - 1 AS rank, step FROM (SELECT b.project, a.t AS step, row_number() OVER (PARTITION BY b.project ORDER BY a.i) AS rank
FROM v_biz b JOIN v_arch r ON r.project = b.project, (VALUES {_step_rows}) a(i, c, t)
WHERE CASE a.c WHEN 'debt' THEN r.debt > 60 WHEN 'tests' THEN contains(r.test_coverage, 'No test') ELSE a.c = b.impact_risk END) WHERE rank <= 6"""))


def _tokens(s, d):
    p = M.file_profile(files(s, d))
    return U.token_estimate(p.select(
        "file_name", M.summary_text().alias("summary"), F.size("method_sigs").alias("methods"), F.size("class_sigs").alias("classes"),
        F.size("property_sigs").alias("properties"), F.coalesce(F.size("hits"), F.lit(0)).alias("hits0"), F.size("modules").alias("imports"), "container", "code_len")
        .withColumn("hits", F.greatest("hits0", F.lit(0))))


register("token_estimate", _tokens, q("""
SELECT file_name, st AS summary_tokens, ct AS code_tokens, CASE WHEN ct > 0 THEN round_even((ct - st) / ct * 100.0::DOUBLE, 2) ELSE 0 END AS reduction_pct FROM (
SELECT v.file_name, CAST(ceil(length(summary) / 4.0) AS BIGINT) + c.methods * 15 + c.classes * 7 + c.properties * 4 + 10 + v.hits * 5 + c.imports * 2 + CASE WHEN n.container <> '' THEN 3 ELSE 0 END AS st,
  CAST(ceil(length(f.content) / 3.5) AS BIGINT) AS ct
FROM v_summary v JOIN v_counts c ON c.file_name = v.file_name JOIN v_container n ON n.file_name = v.file_name JOIN v_files f ON f.file_name = v.file_name)"""))
register("token_budget", lambda s, d: U.token_budget(files(s, d)), q("""
SELECT project, count(*) AS files, CAST(sum(size // 4 + CAST(floor((size // 4) * 0.1::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens, 600 + count(*) * 80 AS prompt_overhead,
  round(sum(size // 4 + CAST(floor((size // 4) * 0.1::DOUBLE) AS BIGINT)) * 0.00003::DOUBLE, 4) AS cost FROM v_files GROUP BY project"""))
register("gt_dataset_stats", lambda s, d: U.gt_dataset_stats(V.gt_files(s, d), V.gt_issues(s, d)), q("""
SELECT 'severity' AS dimension, severity AS label, count(*) AS n FROM v_gt_issues GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM v_gt_issues GROUP BY category
UNION ALL SELECT 'difficulty', difficulty, count(*) FROM v_gt_issues GROUP BY difficulty UNION ALL SELECT 'total issues', '', count(*) FROM v_gt_issues
UNION ALL SELECT 'language', language, CAST(sum(issue_count) AS BIGINT) FROM v_gt_files GROUP BY language UNION ALL SELECT 'total files', '', count(*) FROM v_gt_files"""))
