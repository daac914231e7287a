"""Queries over the dependency graph, reviews and contradictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, symbols as SY
from ..session import cut_lineage
from ..sources import views as V
from .corpus import files
from .oracle import VIEWS, lit, q, re2
from .registry import register

VIEWS["v_declared"] = """
SELECT s.file_name, s.language, c.container AS namespace, s.line, s.kind, s.name, CASE WHEN kind = 'class' THEN name ELSE owner END AS own, s.bases,
  concat_ws('::', s.file_name, c.container, CASE WHEN kind = 'class' THEN name ELSE owner END, CASE WHEN kind <> 'class' THEN name END) AS node_id
FROM v_symbols s JOIN v_container c ON s.file_name = c.file_name
WHERE kind IN ('class', 'method', 'property') AND (kind = 'class' OR owner IS NOT NULL)"""
VIEWS["v_nodes"] = """
SELECT node_id, line, kind, name, file_name, namespace, CASE WHEN kind = 'class' THEN CASE WHEN namespace = '' THEN name ELSE namespace || '.' || name END
  ELSE namespace || '.' || own || '.' || name END AS full_name
FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY line, kind, name) AS rn FROM v_declared) WHERE rn = 1"""
register("dep_nodes", lambda s, d: G.dep_nodes(G.declarations(files(s, d))), q("SELECT * FROM v_nodes"))



def _edges(s, d, fn):
    decl = cut_lineage(G.declarations(files(s, d)))
    return fn(decl, G.dep_nodes(decl))


VIEWS["v_calls"] = f"""
SELECT file_name, node_id, callee, count(*) AS n_calls FROM (
SELECT b.file_name, concat_ws('::', b.file_name, c.container, b.owner, b.name) AS node_id,
  unnest(regexp_extract_all(regexp_replace(body, '^[^(]*\\(', ''), {lit(re2(chr(40) + chr(92) + 'w+' + chr(41) + chr(92) + 's*' + chr(92) + '('))}, 1)) AS callee
FROM v_bodies b JOIN v_container c ON b.file_name = c.file_name WHERE b.kind = 'method' AND b.language = 'csharp' AND b.owner IS NOT NULL)
GROUP BY file_name, node_id, callee"""
VIEWS["v_best"] = """
SELECT kind, name, file_name AS target_file, node_id AS target_id FROM (
SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY length(file_name), file_name, node_id) AS rn FROM v_nodes
WHERE file_name LIKE '%.cs') WHERE rn = 1"""
VIEWS["v_call_edges"] = """
SELECT c.node_id AS source_id, b.target_id, c.file_name AS source_file, b.target_file, 'MethodCall' AS type, c.n_calls
FROM v_calls c JOIN v_best b ON b.name = c.callee AND b.kind = 'method'
WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.file_name = c.file_name AND n.name = c.callee AND n.kind = 'method')"""
register("dep_call_edges", lambda s, d: _edges(s, d, G.call_edges), q("SELECT * FROM v_call_edges"))
VIEWS["v_bases"] = f"""
SELECT DISTINCT file_name, node_id, regexp_extract(trim(b), {lit(re2('(' + chr(92) + 'w+)(?:<.*)?$'))}, 1) AS base FROM (
SELECT file_name, node_id, unnest(string_split(bases, ',')) AS b FROM v_declared WHERE kind = 'class' AND bases <> '' AND language = 'csharp')"""
VIEWS["v_inherit_edges"] = """
SELECT c.node_id AS source_id, b.target_id, c.file_name AS source_file, b.target_file, 'Inheritance' AS type
FROM v_bases c JOIN v_best b ON b.name = c.base AND b.kind = 'class'
WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.file_name = c.file_name AND n.name = c.base AND n.kind = 'class')"""
register("dep_inherit_edges", lambda s, d: _edges(s, d, G.inherit_edges), q("SELECT * FROM v_inherit_edges"))
VIEWS["v_modules"] = """SELECT DISTINCT module, lower(translate(module, '.\\', '//')) AS norm FROM v_imports WHERE module <> ''
AND language IN ('python', 'java', 'javascript', 'typescript', 'go')"""
VIEWS["v_targets"] = """
SELECT module, target_file FROM (SELECT m.module, f.file_name AS target_file, row_number() OVER (PARTITION BY m.module ORDER BY length(f.file_name), f.file_name) AS rn
FROM v_modules m JOIN v_files f ON contains(lower(f.file_name), m.norm) OR contains(m.norm, lower(regexp_extract(f.file_name, '([^/]*)\\.[^.]*$', 1)))) WHERE rn = 1"""
VIEWS["v_first"] = "SELECT file_name, node_id FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY line, node_id) AS rn FROM v_nodes) WHERE rn = 1"
VIEWS["v_import_edges"] = """
SELECT a.node_id AS source_id, b.node_id AS target_id, i.file_name AS source_file, t.target_file, 'TypeReference' AS type, i.module, i.line
FROM v_imports i JOIN v_targets t ON i.module = t.module JOIN v_first a ON a.file_name = i.file_name JOIN v_first b ON b.file_name = t.target_file
WHERE i.file_name <> t.target_file AND i.language IN ('python', 'java', 'javascript', 'typescript', 'go')"""
register("dep_import_edges", lambda s, d: G.import_edges(
    cut_lineage(SY.extract_imports(files(s, d))), files(s, d), cut_lineage(G.dep_nodes(G.declarations(files(s, d))))), q("SELECT * FROM v_import_edges"))

VIEWS["v_degree"] = "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM v_edges UNION ALL SELECT dst FROM v_edges) GROUP BY node"
register("dep_connectivity", lambda s, d: G.connectivity(V.edges(s, d)), q("SELECT * FROM v_degree"))
register("dep_file_maps", lambda s, d: G.file_maps(V.edges(s, d)),
         q("SELECT src AS file_name, 'depends on' AS relation, dst AS other FROM v_edges UNION ALL SELECT dst, 'used by', src FROM v_edges"))

VIEWS["v_all_edges"] = """
SELECT source_id, target_id, source_file, target_file FROM v_call_edges UNION ALL
SELECT source_id, target_id, source_file, target_file FROM v_inherit_edges UNION ALL
SELECT source_id, target_id, source_file, target_file FROM v_import_edges"""
VIEWS["v_all_degree"] = "SELECT node, count(*) AS degree FROM (SELECT source_id AS node FROM v_all_edges UNION ALL SELECT target_id FROM v_all_edges) GROUP BY node"
VIEWS["v_in"] = """
SELECT e.target_id, e.target_file, e.source_file, CASE WHEN n.kind = 'class' THEN n.full_name END AS cls, CASE WHEN n.kind = 'method' THEN n.full_name END AS met
FROM v_all_edges e LEFT JOIN v_nodes n ON n.node_id = e.source_id"""
VIEWS["v_impact"] = """
SELECT n.node_id, n.name, n.kind, n.file_name, coalesce(i.f, 0) AS affected_files, coalesce(i.c, 0) AS affected_classes, coalesce(i.m, 0) AS affected_methods,
  coalesce(d.degree, 0) AS degree, coalesce(d.degree, 0) > 20 AS is_god,
  CASE WHEN coalesce(i.f, 0) > 10 OR coalesce(d.degree, 0) > 20 THEN 'Critical' WHEN coalesce(i.f, 0) > 5 THEN 'High' WHEN coalesce(i.f, 0) > 2 THEN 'Medium' ELSE 'Low' END AS risk
FROM v_nodes n LEFT JOIN (SELECT target_id, count(DISTINCT source_file) AS f, count(DISTINCT cls) AS c, count(DISTINCT met) AS m FROM v_in GROUP BY target_id) i ON i.target_id = n.node_id
LEFT JOIN v_all_degree d ON d.node = n.node_id"""


def _graph(s, d):
    return G.dependency_graph(files(s, d))


register("dep_impact", lambda s, d: G.impact(*_graph(s, d)), q("SELECT * FROM v_impact"))
register("dep_god_nodes", lambda s, d: G.god_nodes(*_graph(s, d)),
         q("SELECT node_id, name, file_name, degree FROM v_impact WHERE kind = 'class' AND degree > 20"))
VIEWS["v_walk"] = """
SELECT source_file AS start, target_file AS here, 1 AS n FROM (SELECT DISTINCT source_file, target_file FROM v_all_edges)
UNION SELECT w.start, e.target_file, w.n + 1 FROM v_walk w JOIN (SELECT DISTINCT source_file, target_file FROM v_all_edges) e ON w.here = e.source_file WHERE w.n < 12"""


def _file_impact(s, d):
    nodes, edges = _graph(s, d)
    links = edges.select(F.col("source_file").alias("src"), F.col("target_file").alias("dst"))
    return G.file_impact(nodes, edges, G.cycle_members(links))


register("dep_file_impact", _file_impact, q("""
SELECT file_name, affected_files, affected_classes, affected_methods, max_degree, in_cycle,
  CASE WHEN affected_files > 10 OR max_degree > 30 OR in_cycle THEN 'Critical' WHEN affected_files > 5 OR max_degree > 20 THEN 'High'
       WHEN affected_files > 2 OR max_degree > 10 THEN 'Medium' ELSE 'Low' END AS risk
FROM (SELECT t.file_name, coalesce(f, 0) AS affected_files, coalesce(c, 0) AS affected_classes, coalesce(m, 0) AS affected_methods, max_degree,
  t.file_name IN (SELECT start FROM v_walk WHERE start = here) AS in_cycle
FROM (SELECT file_name, coalesce(max(degree), 0) AS max_degree FROM v_nodes LEFT JOIN v_all_degree ON node = node_id GROUP BY file_name) t
LEFT JOIN (SELECT target_file, count(DISTINCT source_file) AS f, count(DISTINCT cls) AS c, count(DISTINCT met) AS m FROM v_in GROUP BY target_file) i ON i.target_file = t.file_name)""", recursive=True))
VIEWS["v_paths"] = """
SELECT src AS start, [src, dst] AS path, dst AS last FROM v_edges WHERE src < dst
UNION ALL SELECT p.start, list_append(p.path, e.dst), e.dst FROM v_paths p JOIN v_edges e ON p.last = e.src
WHERE e.dst > p.start AND NOT list_contains(p.path, e.dst) AND len(p.path) < 8"""
VIEWS["v_cycles"] = "SELECT p.path FROM v_paths p JOIN v_edges e ON p.last = e.src AND e.dst = p.start"
VIEWS["v_reach"] = """
SELECT src AS a, dst AS b FROM v_edges UNION SELECT r.a, e.dst FROM v_reach r JOIN v_edges e ON r.b = e.src"""
VIEWS["v_component"] = "SELECT x.a AS node, min(x.b) AS component FROM v_reach x JOIN v_reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a"
register("dep_cycles", lambda s, d: G.cycles(V.edges(s, d)), q("""
SELECT path[1] AS component, n_members, array_to_string(list_append(path, path[1]), ' -> ') AS cycle, len(path) AS n_nodes, least(len(path) + 1, 5) AS severity
FROM v_cycles JOIN (SELECT component, count(*) AS n_members FROM v_component GROUP BY component) ON component = path[1]
QUALIFY row_number() OVER (PARTITION BY path[1] ORDER BY len(path), list_reverse(path)) = 1""", recursive=True))
register("dep_short_cycles", lambda s, d: G.short_cycles(V.edges(s, d), 8),
         q("SELECT array_to_string(list_append(path, path[1]), ' -> ') AS cycle, len(path) AS n_nodes FROM v_cycles", recursive=True))
register("dep_cycle_members", lambda s, d: G.cycle_members(V.edges(s, d)),
         q("SELECT x.a AS node, min(x.b) AS component FROM v_reach x JOIN v_reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a", recursive=True))

register("peer_pairs", lambda s, d: G.peer_pairs(V.analyses(s, d)),
         q("""SELECT a.project, a.agent AS reviewer, b.agent AS reviewee, count(*) AS n_reviews FROM v_analyses a JOIN v_analyses b
ON a.project = b.project AND a.analysis_id <> b.analysis_id GROUP BY ALL"""))


def with_safe(df):
    """Category texts that name the two sides of the evidence check."""
    return df.withColumn("category", F.when(F.col("category") == "SQL Injection", "Security: injection")
                         .when(F.col("category") == "Design", "Safe design").otherwise(F.col("category")))


VIEWS["v_cf"] = """SELECT * REPLACE (CASE category WHEN 'SQL Injection' THEN 'Security: injection' WHEN 'Design' THEN 'Safe design' ELSE category END AS category) FROM v_findings"""
VIEWS["v_ev"] = "SELECT finding_id, category, lower(ev1) AS e FROM v_cf UNION SELECT finding_id, category, lower(ev2) FROM v_cf"
VIEWS["v_contra"] = """
SELECT 'severity at one location' AS kind, a.location AS key, count(DISTINCT a.finding_id) AS n_left, count(DISTINCT b.finding_id) AS n_right,
  min(a.finding_id) AS first_left, min(b.finding_id) AS first_right, count(*) AS n_pairs
FROM v_cf a JOIN v_cf b ON a.location = b.location AND a.severity = 'CRITICAL' AND b.severity = 'LOW' GROUP BY a.location
UNION ALL
SELECT 'security against safe on one evidence', a.e, count(DISTINCT a.finding_id), count(DISTINCT b.finding_id), min(a.finding_id), min(b.finding_id), count(*)
FROM v_ev a JOIN v_ev b ON a.e = b.e AND upper(a.category) LIKE '%SECURITY%' AND upper(b.category) LIKE '%SAFE%' GROUP BY a.e"""
register("contradictions", lambda s, d: G.contradictions(with_safe(V.findings(s, d))), q("SELECT * FROM v_contra"))
