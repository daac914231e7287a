"""DuckDB restatement of the test views, composed into one statement per query.

``q(select)`` scans the text for ``v_...`` names and puts the views it needs,
in dependency order, into a WITH clause.
"""

from __future__ import annotations

import re

from ..data import rules as R
from ..data.snippets import EXTENSIONS, snippet_grid
from ..sources.views import MODULES, SEVERITIES

VIEWS: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(values: list[str], index: str) -> str:
    return "([" + ", ".join(lit(v) for v in values) + f"])[CAST({index} AS BIGINT) + 1]"


def q(select: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in order and name not in inside:
                visit(VIEWS[name], (*inside, name))
                if name not in order:
                    order.append(name)

    visit(select)
    if not order:
        return select
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + select


def flags(p: str, f: str) -> str:
    return f"(?{f}){p}" if f else p


def has(text: str, p: str, f: str = "i") -> str:
    return f"regexp_matches({text}, {lit(flags(p, f))})"


def n_of(text: str, p: str, f: str = "i") -> str:
    return f"len(regexp_extract_all({text}, {lit(flags(p, f))}))"


_CATEGORY = ("CASE event_type WHEN 'error' THEN 'SQL Injection' WHEN 'signup' THEN 'Authentication' "
             "WHEN 'purchase' THEN 'Performance' WHEN 'click' THEN 'Architecture' ELSE 'Design' END")
_FCAT = f"CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'Naming' ELSE {_CATEGORY} END"
_STEP = "CASE WHEN value < 25 THEN 0 WHEN value < 75 THEN 1 WHEN value < 150 THEN 2 ELSE 3 END"
_LINE = "(event_id // 50 % 40 + 1)"
_AGENTS = ["security", "performance", "architecture"]

VIEWS["v_files0"] = f"""
SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS src,
       {pick(EXTENSIONS, 'doc_id % 7')} AS ext,
       {pick(snippet_grid(), '(doc_id % 7) * 12 + doc_id % 12')} || chr(10) || text AS content, n_chars
FROM documents"""
# every non-ASCII character of the test data is a letter, so replacing it by one makes RE2's ASCII
# word classes agree with Unicode ones (column atext)
VIEWS["v_files"] = f"""
SELECT 'app/' || {pick(MODULES, 'src % 5')} || '/Unit' || (doc_id % 50) || '_' || doc_id || '.' || ext AS file_name,
       {pick(MODULES, 'src % 5')} AS module, src % 4 AS project, ext, content,
       regexp_replace(content, '[^\\x00-\\x7f]', 'z', 'g') AS atext, n_chars AS size,
       CAST(DATE '2012-01-01' + CAST(doc_id % 4000 AS INTEGER) AS DATE) AS last_modified,
       CASE ext WHEN 'cs' THEN 'csharp' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'
                WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' ELSE 'unknown' END AS language
FROM v_files0"""
VIEWS["v_web_files"] = """
SELECT regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) || '_' || page_id || '.js' AS file_name,
       'javascript' AS language, html AS content, regexp_replace(html, '[^\\x00-\\x7f]', 'z', 'g') AS atext
FROM pages"""
VIEWS["v_findings"] = f"""
SELECT event_id AS finding_id, event_id % 10 + 1 AS run_number, {pick(_AGENTS, 'user_id % 3')} AS agent,
       {_FCAT} AS category, {pick(SEVERITIES, _STEP)} AS severity,
       'Unit' || (event_id % 50) || '.cs:' || {_LINE} AS location,
       {_FCAT} || ' in Unit' || (event_id % 50) || '.cs:' || {_LINE} AS description,
       event_type AS ev1, props AS ev2
FROM events"""
VIEWS["v_run_findings"] = """
SELECT finding_id, finding_id // 400 % 10 + 1 AS run_number, agent, category, severity,
       'Unit' || (finding_id % 400) || '.cs:' || (finding_id // 50 % 200 + 1) AS location
FROM v_findings"""
VIEWS["v_gt_issues"] = f"""
SELECT 'GT' || event_id AS issue_id, event_id AS issue_order,
       CASE WHEN event_id % 2 = 1 THEN CASE event_type WHEN 'error' THEN 'sqli' WHEN 'signup' THEN 'auth'
            WHEN 'purchase' THEN 'perf' WHEN 'click' THEN 'arch' ELSE 'design' END ELSE {_CATEGORY} END AS category,
       {pick(SEVERITIES, f'CASE WHEN event_id % 3 = 0 THEN greatest({_STEP} - 1, 0) ELSE {_STEP} END')} AS severity,
       'Unit' || (event_id % 50) || '.cs:' || {_LINE} AS location,
       CASE WHEN event_id % 15 <> 0 THEN {_LINE} + event_id % 9 - 4 END AS line_number,
       CASE WHEN event_id % 10 <> 0 THEN {pick(_AGENTS, 'event_id % 3')} END AS expected_agent,
       event_id % 20 <> 0 AS is_mandatory, {pick(['easy', 'medium', 'hard'], 'event_id % 3')} AS difficulty
FROM events"""
VIEWS["v_gt_files"] = f"SELECT doc_id AS file_id, {pick(EXTENSIONS, 'doc_id % 7')} AS language, n_chars % 4 AS issue_count FROM documents"
VIEWS["v_analyses"] = f"""
SELECT o_orderkey AS analysis_id, o_custkey AS project,
       {pick(['SecurityAgent', 'PerformanceAgent', 'ArchitecturalAgent', 'OtherAgent'], 'o_orderkey % 4')} AS agent,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
            WHEN '5-LOW' THEN 'LOW' ELSE '' END AS priority,
       o_orderkey % 101 AS confidence, o_orderdate AS ts, o_orderkey % 17 = 0 AS is_error
FROM orders"""
VIEWS["v_recommendations"] = """
SELECT l_orderkey AS analysis_id, 'Rec ' || (l_partkey % 40) AS title, CAST(l_quantity AS DECIMAL(12,2)) AS hours,
       CASE WHEN l_linenumber = 7 THEN '' WHEN l_returnflag = 'A' THEN 'HIGH' WHEN l_returnflag = 'R' THEN 'MEDIUM'
            ELSE 'LOW' END AS priority
FROM lineitem"""
VIEWS["v_messages"] = f"""
SELECT conv_id, turn, role AS from_agent, {pick(['Analysis', 'PeerReview', 'Challenge', 'Synthesis'], 'turn % 4')} AS type,
       text, 1704067200 + (conv_id * 60 + turn) * 60 AS ts_sec
FROM conversations"""
VIEWS["v_resp0"] = f"""
SELECT conv_id, turn, text, {pick(_AGENTS, 'conv_id % 3')} AS agent, 'Unit' || (conv_id % 50) || '.cs' AS file,
       text AS first, substr(CAST(to_json(text) AS VARCHAR), 2, length(CAST(to_json(text) AS VARCHAR)) - 2) AS esc
FROM conversations WHERE role = 'assistant'"""
VIEWS["v_resp1"] = """
SELECT *, '{"confidenceScore": ' || (conv_id % 90 + 10) || ', "businessImpact": "cost risk", "findings": [' ||
  CASE WHEN turn % 3 = 0 THEN '' ELSE '{"category": "SQL Injection", "description": "' || esc ||
       '", "severity": "HIGH", "location": "' || file || ':7"}' END ||
  '], "recommendations": [{"title": "Fix ' || (turn % 5) || '", "estimatedHours": ' || (conv_id % 40) ||
  ', "priority": "HIGH"}], "semanticIssues": [{"issueType": "TypeSafety", "category": "naming", "severity": ' || (conv_id % 5) ||
  ', "lineNumber": ' || (turn + 1) || '}], "analyses": [{"fileName": "' || file || '", "assessment": "' || esc || '"}]}' AS body
FROM v_resp0"""
VIEWS["v_responses"] = """
SELECT conv_id || '-' || turn AS response_id, agent, conv_id, turn, file AS expected_file, first,
  conv_id % 4 AS shape,
  CASE conv_id % 4 WHEN 0 THEN body
    WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 2 THEN 'Result follows. ' || split_part(body, ']}', 1) || ',]} thanks'
    ELSE 'Finding: critical SQL injection in ' || file || ' line 12' || chr(10) || 'Issue: high memory risk in class Cart' || chr(10) ||
      '1. Review authentication design' || chr(10) || '- Improve database caching and refactor the pattern' || chr(10) ||
      'Recommendation: add tests.' || chr(10) || text END AS raw
FROM v_resp1"""
VIEWS["v_edges0"] = """
SELECT p_partkey AS s, unnest([p_partkey // 8 * 8 + (p_partkey * 3 + 1) % 8,
       CASE WHEN p_partkey % 5 = 0 THEN p_partkey // 8 * 8 + (p_partkey + 1) % 8 END]) AS d
FROM part"""
VIEWS["v_edges"] = "SELECT DISTINCT 'F' || s AS src, 'F' || d AS dst FROM v_edges0 WHERE d IS NOT NULL AND s <> d"
VIEWS["v_requests"] = f"""
SELECT event_id AS request_id, user_id % 20 AS client, 'agent' || (user_id % 10) AS agent,
       1704067200000 + (epoch_us(ts) - 1704067200000000) // 600000 AS ts_ms,
       event_type || ':' || (user_id % 7) AS fingerprint_key, {pick(['gpt-4', 'gpt-35-turbo'], 'event_id % 2')} AS model,
       CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens,
       event_type AS operation, CAST(floor(value * 100) AS BIGINT) AS duration_ms, value
FROM events"""
VIEWS["v_sessions"] = """
SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderpriority AS analysis_type,
       CAST(floor(o_totalprice % 101) AS BIGINT) AS overall_score FROM orders"""
VIEWS["v_session_files"] = """
SELECT l_orderkey AS session_id, 'File' || l_partkey || '_' || l_linenumber || '.cs' AS file_name,
       CAST(l_quantity AS BIGINT) AS complexity FROM lineitem"""
VIEWS["v_confidence"] = """
SELECT vec_id AS finding_id, list_transform(embedding[1:4], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000, 0) AS BIGINT)) AS parts,
       CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 0 ELSE vec_id % 140 - 20 END AS score
FROM embeddings"""


def re2(p: str) -> str:
    """Unicode word class for RE2 where matched text is returned, not just tested."""
    out, in_class, i = [], False, 0
    while i < len(p):
        two = p[i:i + 2]
        if two == r"\w":
            out.append(r"\p{L}\p{N}_" if in_class else r"[\p{L}\p{N}_]")
            i += 2
        elif p[i] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = {"[": True, "]": False}.get(p[i], in_class)
            out.append(p[i])
            i += 1
    return "".join(out)
