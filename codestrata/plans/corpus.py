"""Queries over the file corpus: screens, symbols, measures, rules, legacy and smells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..data import rules as R
from ..functions import text as TX
from ..operators import legacy as L, measures as M, rulescan as RS, screening as SC, smells as SM, symbols as SY
from ..session import cut_lineage
from ..sources import views as V
from .oracle import VIEWS, flags, has, lit, n_of, q, re2
from .registry import register


def files(spark: SparkSession, d: str, **cols) -> DataFrame:
    return V.files(spark, d).withColumn("language", TX.detect_language(F.col("file_name")))


# --------------------------------------------------------------------------- 2.2
def _meta(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    hits = RS.hit_counts(f, extra=["content"])
    return M.cyclomatic(hits, ["security_hits", "performance_hits", "architecture_hits"])


register("detect_language", lambda s, d: files(s, d).groupBy("language").agg(F.count("*").alias("n")),
         q("SELECT language, count(*) AS n FROM v_files GROUP BY language"))

_generated = " AND ".join(f"file_name NOT LIKE '%{m}%'" for m in [".Designer.", ".g.cs", ".g.i.cs", "AssemblyInfo.cs", "/bin/", "/obj/"])
register("filter_source_files", lambda s, d: SC.filter_source_files(files(s, d)).select("file_name", "language"),
         q(f"SELECT file_name, language FROM v_files WHERE language <> 'unknown' AND {_generated} "
           "AND lower(regexp_extract(file_name, '[^/]*$')) NOT LIKE 'temp%'"))

register("screen_files", lambda s, d: SC.screen_files(files(s, d)).select("file_name", F.coalesce("reason", F.lit("")).alias("reason"), "is_valid"),
         q("""SELECT file_name, reason, reason = '' AS is_valid FROM (
SELECT file_name, CASE WHEN trim(base) = '' THEN 'empty name' WHEN length(base) > 255 THEN 'name too long'
  WHEN regexp_matches(base, '[<>:"/\\\\|?*\\x00]') THEN 'forbidden character'
  WHEN regexp_extract(lower(base), '\\.([^.]+)$', 1) NOT IN ('cs','py','js','ts','java','go','vb','fs','cpp','h') THEN 'extension not allowed'
  WHEN size > 5242880 THEN 'file too large' ELSE '' END AS reason
FROM (SELECT file_name, size, regexp_extract(file_name, '[^/]*$') AS base FROM v_files))"""))

_susp = ", ".join(f"CASE WHEN {has('atext', p)} THEN {lit(p)} END" for p in SC.SUSPICIOUS)


def _all_files(s, d):
    return files(s, d).select("file_name", "language", "content").unionByName(V.web_files(s, d))


VIEWS["v_all_files"] = ("SELECT file_name, language, content, atext FROM v_files UNION ALL "
                        "SELECT file_name, language, content, atext FROM v_web_files")
register("scan_suspicious", lambda s, d: SC.scan_suspicious(_all_files(s, d)).select("file_name", F.array_join("patterns", " ").alias("patterns")),
         q(f"SELECT file_name, patterns FROM (SELECT file_name, array_to_string(list_filter([{_susp}], lambda x: x IS NOT NULL), ' ') "
           "AS patterns FROM v_all_files) WHERE patterns <> ''"))

_inj = " OR ".join(has("text", p) for p in SC.PROMPT_INJECTION)
register("screen_prompts", lambda s, d: SC.screen_prompts(V.messages(s, d)).select("conv_id", "turn", F.coalesce("reason", F.lit("")).alias("reason"), "is_valid"),
         q(f"""SELECT conv_id, turn, reason, reason = '' AS is_valid FROM (SELECT conv_id, turn,
CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 2000 THEN 'too long'
WHEN contains(text, chr(13) || chr(10)) OR contains(text, chr(10) || chr(13)) OR contains(text, chr(0)) THEN 'forbidden character'
WHEN {_inj} THEN 'injection' ELSE '' END AS reason FROM v_messages)"""))

register("normalise_text", lambda s, d: V.messages(s, d).select("conv_id", "turn", TX.normalise_text(F.col("text")).alias("text")),
         q("SELECT conv_id, turn, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 2000) AS text FROM v_messages"))

# cyclomatic per file, and hits per family, as views
VIEWS["v_lines"] = ("SELECT file_name, language, u.line AS line, u.text AS text FROM (SELECT file_name, language, "
                    "unnest(list_transform(string_split(content, chr(10)), lambda x, i: {'line': i, 'text': x})) AS u FROM v_files)")


def _case_marks() -> str:
    sel = {f: [] for f in ["kind", *SY.FIELDS]}
    for lang, grammar in SY.GRAMMAR.items():
        for kind, p, groups in grammar:
            p2 = re2(p)
            cond = f"language = '{lang}' AND regexp_matches(text, {lit(p2)})"
            if lang in ("javascript", "typescript") and kind == "method":
                words = ", ".join(lit(w) for w in SY.JS_KEYWORDS)
                cond += f" AND regexp_extract(text, {lit(p2)}, {groups['name']}) NOT IN ({words})"
            sel["kind"].append(f"WHEN {cond} THEN '{kind}'")
            for f in SY.FIELDS:
                if f in groups:
                    sel[f].append(f"WHEN language = '{lang}' AND kind = '{kind}' THEN regexp_extract(text, {lit(p2)}, {groups[f]})")
    kind = "CASE " + " ".join(sel["kind"]) + " END"
    cols = ", ".join(f"CASE {' '.join(sel[f])} ELSE '' END AS {f}" for f in SY.FIELDS)
    bases = []
    for lang, ps in SY.BASES.items():
        if ps:
            parts = ", ".join(f"nullif(trim(regexp_extract(text, {lit(re2(p))}, 1)), '')" for p in ps)
            bases.append(f"WHEN language = '{lang}' AND kind = 'class' THEN concat_ws(', ', {parts})")
    return (f"SELECT file_name, language, line, kind, {cols}, CASE {' '.join(bases)} ELSE '' END AS bases "
            f"FROM (SELECT *, {kind} AS kind FROM v_lines) WHERE kind IS NOT NULL")


VIEWS["v_marks"] = _case_marks()
VIEWS["v_nlines"] = "SELECT file_name, language, string_split(content, chr(10)) AS arr, len(string_split(content, chr(10))) AS loc FROM v_files"
VIEWS["v_symbols"] = """
SELECT m.file_name, m.language, m.line, kind, name, mods, rtype, params, bases,
  CASE WHEN kind = 'class' THEN NULL WHEN recv <> '' THEN recv
       ELSE last_value(CASE WHEN kind = 'class' THEN name END IGNORE NULLS) OVER w END AS owner,
  coalesce(lead(m.line) OVER (PARTITION BY m.file_name ORDER BY m.line), loc + 1) AS next_line,
  regexp_extract(mods, '\\b(public|private|protected|internal)\\b', 1) AS access,
  contains(mods, 'static') AS is_static, contains(mods, 'async') AS is_async
FROM v_marks m JOIN v_nlines n ON m.file_name = n.file_name
WINDOW w AS (PARTITION BY m.file_name ORDER BY m.line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
VIEWS["v_bodies"] = """
SELECT s.*, array_to_string(arr[s.line:s.next_line - 1], chr(10)) AS body FROM v_symbols s JOIN v_nlines n ON s.file_name = n.file_name"""
VIEWS["v_cyclo"] = f"""
SELECT f.file_name, f.language, len(string_split(content, chr(10))) AS loc,
  greatest(1, CASE WHEN f.language = 'csharp' THEN coalesce(m.c, 0) ELSE {n_of('atext', R.DECISIONS, '')} + 1 END) AS cyclomatic
FROM v_files f LEFT JOIN (SELECT file_name, CAST(sum({n_of("regexp_replace(body, '[^\\x00-\\x7f]', 'z', 'g')", R.DECISIONS_CSHARP, '')} + 1) AS BIGINT) AS c
  FROM v_bodies WHERE kind = 'method' AND language = 'csharp' GROUP BY file_name) m ON f.file_name = m.file_name"""


def _rule_sql(r: R.Rule, text: str = "atext") -> str:
    if r.duckdb:  # "value not followed on its line by a hashing word"
        stem = r.must[0].split("(?!")[0]
        open_end = f"regexp_matches({text}, {lit('(?i)' + stem + '(' + chr(92) + 'n|' + chr(92) + 'z)')})"
        tail = (f"len(list_filter(regexp_extract_all({text}, {lit('(?i)' + stem + '([,}][^' + chr(92) + 'n]*)')}, 1), "
                f"lambda x: NOT regexp_matches(x, {lit('(?i)' + r.duckdb)}))) > 0")
        return f"({open_end} OR {tail})"
    f = r.flags
    if r.min_count:
        cond = f"{n_of(text, r.must[0], f)} > {r.min_count}"
    else:
        cond = "(" + " OR ".join(has(text, p, f) for p in r.must) + ")"
    for p in r.also:
        cond += f" AND {has(text, p, f)}"
    for p in r.must_not:
        cond += f" AND NOT {has(text, p, f)}"
    return cond


def _rules_union(rules: list[R.Rule]) -> str:
    parts = []
    for r in rules:
        langs = ", ".join(lit(x) for x in r.languages)
        parts.append(f"SELECT file_name, language, '{r.rule_id}' AS rule_id, '{r.family}' AS family, '{r.severity}' AS severity "
                     f"FROM v_files WHERE language IN ({langs}) AND {_rule_sql(r)}")
    return " UNION ALL ".join(parts)


VIEWS["v_hits"] = _rules_union(R.ALL_RULES)
VIEWS["v_hits_security"] = _rules_union(R.SECURITY)
VIEWS["v_hits_performance"] = _rules_union(R.PERFORMANCE)
VIEWS["v_hits_architecture"] = _rules_union(R.ARCHITECTURE)
VIEWS["v_meta"] = """
SELECT c.file_name, c.language, c.loc, c.cyclomatic,
  coalesce(h.sec, 0) AS security_hits, coalesce(h.perf, 0) AS performance_hits, coalesce(h.arch, 0) AS architecture_hits
FROM v_cyclo c LEFT JOIN (SELECT file_name, count(*) FILTER (family = 'security') AS sec, count(*) FILTER (family = 'performance') AS perf,
  count(*) FILTER (family = 'architecture') AS arch FROM v_hits GROUP BY file_name) h ON c.file_name = h.file_name"""

_KEEP = {"security": "security_hits > 0", "complexity": "cyclomatic >= 15", "performance": "performance_hits > 0"}
for _key, _by in [("keep_security_files", "security"), ("keep_complex_files", "complexity"), ("keep_perf_files", "performance")]:
    register(_key, lambda s, d, by=_by: SC.keep_files(_meta(s, d), by).select("file_name", "security_hits", "performance_hits", "cyclomatic"),
             q(f"SELECT file_name, security_hits, performance_hits, cyclomatic FROM v_meta WHERE {_KEEP[_by]}"))
register("keep_report", lambda s, d: SC.keep_report(_meta(s, d)),
         q(" UNION ALL ".join(
             f"SELECT '{k}' AS filter_name, count(*) AS total, count(*) FILTER ({c}) AS kept, "
             f"round((count(*) - count(*) FILTER ({c})) / count(*) * 100.0, 4) AS reduction_pct FROM v_meta" for k, c in _KEEP.items())))


def _specialty(s, d):
    meta = cut_lineage(_meta(s, d).select("file_name", "language", "security_hits", "performance_hits", "cyclomatic"))  # slim: the text is read once
    # the third specialty has no filter of its own; "impossible" shows the fall-back to all rows
    a = SC.specialty_view(meta, "security").select(F.lit("security").alias("specialty"), "file_name", "cyclomatic")
    b = SC.specialty_view(meta, "performance").select(F.lit("performance").alias("specialty"), "file_name", "cyclomatic")
    c = SC.specialty_view(meta.where("language = 'unknown'"), "security").select(F.lit("fallback").alias("specialty"), "file_name", "cyclomatic")
    return a.unionByName(b).unionByName(c)


register("specialty_view", _specialty,
         q("SELECT 'security' AS specialty, file_name, cyclomatic FROM v_meta WHERE security_hits > 0 UNION ALL "
           "SELECT 'performance', file_name, cyclomatic FROM v_meta WHERE cyclomatic >= 15 UNION ALL "
           "SELECT 'fallback', file_name, cyclomatic FROM v_meta WHERE language = 'unknown'"))


def redact_sql(x: str) -> str:
    for p in SC.REDACTIONS:
        x = f"regexp_replace({x}, {lit(flags(p, 'i'))}, '\\1: [REDACTED]', 'g')"
    return x


VIEWS["v_redacted"] = f"SELECT doc_id, {redact_sql('text')} AS t FROM documents"
register("redact_text", lambda s, d: V.spread(V.table(s, d, "documents").select("doc_id", "text")).select("doc_id", SC.redact_text(F.col("text")).alias("text")),
         q("SELECT doc_id, CASE WHEN length(t) > 5000 THEN substr(t, 1, 5000) || '... [TRUNCATED]' ELSE t END AS text FROM v_redacted"))


def _code_sql(x: str) -> str:
    n = " + ".join(f"CAST(contains(lower({x}), {lit(m)}) AS INTEGER)" for m in SC.CODE_MARKS)
    return f"(length({x}) >= 20 AND trim({x}) <> '' AND ({n}) >= 3)"


def _file_sql(x: str) -> str:
    return f"(length({x}) >= 50 AND trim({x}) <> '' AND (length({x}) > 200 OR contains({x}, chr(10)) OR contains({x}, chr(13))))"


def _mask_sql(x: str) -> str:
    cut = f"CASE WHEN length({x}) <= 100 THEN {x} ELSE substr({x}, 1, 100) || '... [CODE REDACTED - ' || length({x}) || ' chars total]' END"
    red = redact_sql(x)
    return (f"CASE WHEN {_code_sql(x)} OR {_file_sql(x)} THEN {cut} WHEN length({red}) > 5000 THEN substr({red}, 1, 5000) || '... [TRUNCATED]' "
            f"ELSE {red} END")


def _mask(s, d):
    m = V.messages(s, d)
    bag = F.create_map(F.lit("accessToken"), F.col("from_agent"), F.lit("body"), F.col("text"),
                       F.lit("snippet"), F.concat(F.lit("public class A { return "), F.col("from_agent"), F.lit("; }")),
                       F.lit("note"), F.concat(F.lit("password="), F.col("type")))
    e = V.table(s, d, "events").select("event_id", SC.mask_fields(F.from_json("props", "map<string,string>")).alias("m"))
    out = m.select("conv_id", "turn", SC.mask_fields(bag).alias("m"))
    names = ["accessToken", "body", "snippet", "note"]
    a = out.select(F.concat_ws("-", "conv_id", "turn").alias("row_id"),
                   *[F.col("m").getItem(n).alias(n.lower()) for n in names], F.lit("").alias("k"))
    b = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("row_id"), *[F.lit("").alias(n.lower()) for n in names],
                 F.col("m").getItem("k").alias("k"))
    return a.unionByName(b)


VIEWS["v_bag"] = ("SELECT conv_id || '-' || turn AS row_id, text AS body, 'public class A { return ' || from_agent || '; }' AS snippet, "
                  "'password=' || type AS note FROM v_messages")
register("mask_fields", _mask,
         q(f"SELECT row_id, '[REDACTED]' AS accesstoken, {_mask_sql('body')} AS body, {_mask_sql('snippet')} AS snippet, {_mask_sql('note')} AS note, "
           "'' AS k FROM v_bag UNION ALL SELECT 'e' || event_id, '', '', '', '', json_extract_string(props, '$.k') FROM events"))

register("flag_code_like", lambda s, d: files(s, d).select("file_name", SC.code_like(F.col("content")).alias("is_code"), SC.file_like(F.col("content")).alias("is_file"))
         .unionByName(V.messages(s, d).select(F.concat_ws("-", "conv_id", "turn").alias("file_name"), SC.code_like(F.col("text")).alias("is_code"),
                                              SC.file_like(F.col("text")).alias("is_file"))),
         q(f"SELECT file_name, {_code_sql('content')} AS is_code, {_file_sql('content')} AS is_file FROM v_files UNION ALL "
           f"SELECT conv_id || '-' || turn, {_code_sql('text')}, {_file_sql('text')} FROM v_messages"))

# --------------------------------------------------------------------------- 2.3
register("explode_lines", lambda s, d: SY.explode_lines(files(s, d)), q("SELECT file_name, language, line, text FROM v_lines"))
register("extract_classes", lambda s, d: SY.extract_symbols(files(s, d), "class").select("file_name", "language", "line", "name", "bases", "access"),
         q("SELECT file_name, language, line, name, bases, access FROM v_symbols WHERE kind = 'class'"))
register("extract_functions", lambda s, d: SY.extract_symbols(files(s, d), "method").select(
    "file_name", "language", "line", "name", F.coalesce("owner", F.lit("")).alias("owner"), "access", "is_static", "is_async"),
    q("SELECT file_name, language, line, name, coalesce(owner, '') AS owner, access, is_static, is_async FROM v_symbols WHERE kind = 'method'"))
register("extract_properties", lambda s, d: SY.extract_symbols(files(s, d), "property").select(
    "file_name", "line", "name", "rtype", F.col("params").contains("get").alias("has_getter"), F.col("params").contains("set").alias("has_setter")),
    q("SELECT file_name, line, name, rtype, contains(params, 'get') AS has_getter, contains(params, 'set') AS has_setter FROM v_symbols WHERE kind = 'property'"))


def _imports_sql() -> str:
    parts = []
    for lang, (p, groups, wild) in SY.IMPORTS.items():
        name = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {lit(re2(p))}, {g}), '')" for g in groups) + ", '')"
        parts.append(f"SELECT file_name, language, line, {name} AS module, regexp_matches(text, {lit(re2(wild))}) AS is_wildcard FROM v_lines "
                     f"WHERE language = '{lang}' AND regexp_matches(text, {lit(re2(p))})")
    return " UNION ALL ".join(parts)


VIEWS["v_imports"] = _imports_sql()
register("extract_imports", lambda s, d: SY.extract_imports(files(s, d)), q("SELECT file_name, language, line, module, is_wildcard FROM v_imports"))
VIEWS["v_container"] = "SELECT file_name, language, CASE " + " ".join(
    f"WHEN language = '{lang}' THEN regexp_extract(content, {lit('(?m)' + re2(p))}, 1)" for lang, p in SY.CONTAINERS.items()) + " ELSE '' END AS container FROM v_files"
register("extract_container", lambda s, d: SY.extract_container(files(s, d)), q("SELECT file_name, language, container FROM v_container"))

VIEWS["v_counts"] = """
SELECT n.file_name, n.language, coalesce(s.classes, 0) AS classes, coalesce(s.methods, 0) AS methods,
  coalesce(s.properties, 0) AS properties, coalesce(i.imports, 0) AS imports, n.loc
FROM v_nlines n
LEFT JOIN (SELECT file_name, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'method') AS methods,
  count(*) FILTER (kind = 'property') AS properties FROM v_symbols GROUP BY file_name) s ON n.file_name = s.file_name
LEFT JOIN (SELECT file_name, count(*) AS imports FROM v_imports GROUP BY file_name) i ON n.file_name = i.file_name"""
register("file_counts", lambda s, d: SY.file_counts(files(s, d)), q("SELECT * FROM v_counts"))
register("cyclomatic", lambda s, d: M.cyclomatic(files(s, d)), q("SELECT file_name, language, loc, cyclomatic FROM v_cyclo"))


def _score(fn):
    return fn(F.col("classes"), F.col("methods"), F.col("imports"))


register("file_complexity", lambda s, d: SY.file_counts(files(s, d)).select("file_name", _score(M.file_complexity).alias("score")),
         q("SELECT file_name, least(greatest(classes * 10 + methods * 2 + imports, 0), 100) AS score FROM v_counts"))
register("report_complexity", lambda s, d: SY.file_counts(files(s, d)).select(
    "file_name", _score(M.report_complexity).alias("report_score"), _score(M.page_complexity).alias("page_score")),
    q("SELECT file_name, least((classes * 3 + methods + imports * 2) // 2, 100) AS report_score, "
      "least((classes * 10 + methods * 2 + imports * 3) // 5, 100) AS page_score FROM v_counts"))
_py = "language = 'python'"
VIEWS["v_bounds"] = f"""
SELECT l.file_name, l.language, l.line, n.loc,
  CASE WHEN l.{_py} THEN regexp_matches(text, {lit(M.PY_START)}) ELSE regexp_matches(text, {lit(M.X_START)}) END AS is_start
FROM v_lines l JOIN v_nlines n ON l.file_name = n.file_name
WHERE l.language IN ('python', 'javascript', 'typescript', 'java', 'go')
  AND CASE WHEN l.{_py} THEN regexp_matches(text, {lit(M.PY_END)}) ELSE regexp_matches(text, {lit(M.X_END)}) END"""
VIEWS["v_flen"] = """
SELECT file_name, language, line, length FROM (SELECT file_name, language, line, is_start,
  coalesce(lead(line) OVER (PARTITION BY file_name ORDER BY line), loc + 1) - line AS length FROM v_bounds) WHERE is_start
UNION ALL SELECT file_name, language, line, next_line - line FROM v_symbols WHERE language = 'csharp' AND kind = 'method'"""
register("function_length", lambda s, d: M.function_length(files(s, d)),
         q("SELECT file_name, language, line, length, length > 50 AS is_long FROM v_flen"))
VIEWS["v_signatures"] = """
SELECT file_name, kind, line, CASE kind
 WHEN 'class' THEN access || ' class ' || name || CASE WHEN bases <> '' THEN ' : ' || bases ELSE '' END
 WHEN 'method' THEN concat_ws(' ', nullif(access, ''), CASE WHEN is_static THEN 'static' END, CASE WHEN is_async THEN 'async' END)
   || ' ' || CASE WHEN rtype <> '' THEN rtype ELSE 'void' END || ' ' || coalesce(owner || '.', '') || name || '(' || trim(params) || ')'
 ELSE access || ' ' || rtype || ' ' || coalesce(owner || '.', '') || name || ' { ' || CASE WHEN contains(params, 'get') THEN 'get; ' ELSE '' END
   || CASE WHEN contains(params, 'set') THEN 'set; ' ELSE '' END || '}' END AS signature
FROM v_symbols WHERE kind IN ('class', 'method', 'property')"""
register("signatures", lambda s, d: SY.signatures(SY.extract_symbols(files(s, d))), q("SELECT * FROM v_signatures"))
_anc = " OR ".join(has("content", p) for p in R.ANCIENT_FRAMEWORK)
VIEWS["v_age"] = f"""SELECT file_name, CAST(trunc((DATE '2024-01-01' - last_modified) / 365.0) AS BIGINT) AS age_years,
 (DATE '2024-01-01' - last_modified) / 365.0 > 5 AS is_very_old, ({_anc}) AS is_ancient FROM v_files"""
register("legacy_age", lambda s, d: M.legacy_age(files(s, d), V.AS_OF), q("SELECT * FROM v_age"))

# --------------------------------------------------------------------------- 2.4
for _fam, _rules in [("security", R.SECURITY), ("performance", R.PERFORMANCE), ("architecture", R.ARCHITECTURE)]:
    if _fam != "architecture":
        register(f"rule_scan_{_fam}", lambda s, d, r=_rules: RS.rule_scan(files(s, d), r), q(f"SELECT * FROM v_hits_{_fam}"))


def _architecture(s, d):
    f = files(s, d)
    hits = RS.rule_scan(f, R.ARCHITECTURE)
    long = M.function_length(f).where("is_long AND language <> 'csharp'").groupBy("file_name", "language").agg(F.count("*").alias("n"))
    return hits.unionByName(long.select("file_name", "language", F.lit("long-function").alias("rule_id"),
                                        F.lit("architecture").alias("family"), F.lit("Medium").alias("severity")))


register("rule_scan_architecture", _architecture,
         q("SELECT * FROM v_hits_architecture UNION ALL SELECT DISTINCT file_name, language, 'long-function', 'architecture', 'Medium' "
           "FROM v_flen WHERE language <> 'csharp' AND length > 50"))


def _registry(s, d):
    base = RS.rules_table(s, R.SECURITY)
    new = RS.rules_table(s, [R.Rule("go-panic", ("go",), "security", "High", (r"\bpassword\b",)),
                             R.Rule("txt-token", ("unknown",), "security", "Low", (r"token\s*=",))])
    return RS.rule_scan_table(files(s, d), RS.register_rules(base, new))


register("rule_registry", _registry,
         q("SELECT * FROM v_hits_security WHERE language <> 'go' UNION ALL "
           "SELECT file_name, language, 'go-panic', 'security', 'High' FROM v_files WHERE language = 'go' AND regexp_matches(atext, '(?i)\\bpassword\\b') UNION ALL "
           "SELECT file_name, language, 'txt-token', 'security', 'Low' FROM v_files WHERE language = 'unknown' AND regexp_matches(atext, '(?i)token\\s*=')"))


def located_sql(patterns: list[tuple[str, str]], where: str = "TRUE") -> str:
    """Put a mark before every match, split at the marks, count newlines before each piece."""
    parts = []
    for pid, p in patterns:
        p2 = lit("(?i)(" + re2(p) + ")")
        parts.append(
            f"SELECT file_name, language, '{pid}' AS pattern_id, "
            f"unnest(list_transform(string_split(regexp_replace(content, {p2}, chr(1) || '\\1', 'g'), chr(1))[2:], lambda x: regexp_extract(x, {lit('(?i)^(' + re2(p) + ')')}, 1))) AS snippet, "
            f"unnest(range(1, len(string_split(regexp_replace(content, {p2}, chr(1) || '\\1', 'g'), chr(1))))) AS k, "
            f"string_split(regexp_replace(content, {p2}, chr(1) || '\\1', 'g'), chr(1)) AS pieces "
            f"FROM v_files WHERE ({where}) AND regexp_matches(content, {p2})")
    inner = " UNION ALL ".join(parts)
    return (f"SELECT file_name, language, pattern_id, 1 + length(array_to_string(pieces[1:k], '')) - "
            f"length(replace(array_to_string(pieces[1:k], ''), chr(10), '')) AS line, snippet FROM ({inner})")


VIEWS["v_api"] = located_sql(L.numbered("api", R.OBSOLETE_API))
register("legacy_obsolete_api", lambda s, d: L.obsolete_api(files(s, d)), q("SELECT * FROM v_api"))
VIEWS["v_gs"] = located_sql(L.numbered("gs", R.GLOBAL_STATE), "language <> 'csharp'")
VIEWS["v_gs_static"] = """SELECT file_name, string_agg(name, ', ' ORDER BY line) AS snippet FROM v_symbols
WHERE language = 'csharp' AND kind = 'field' AND contains(mods, 'static') AND contains(mods, 'public') GROUP BY file_name HAVING count(*) > 3"""
VIEWS["v_global_state"] = """
SELECT file_name, line, 'Medium' AS severity, snippet FROM v_gs UNION ALL
SELECT file_name, 1 + length(split_part(content, 'HttpContext.Current', 1)) - length(replace(split_part(content, 'HttpContext.Current', 1), chr(10), '')),
  'High', 'HttpContext.Current' FROM v_files WHERE language = 'csharp' AND contains(content, 'HttpContext.Current') UNION ALL
SELECT file_name, NULL, 'Medium', snippet FROM v_gs_static"""
register("legacy_global_state", lambda s, d: L.global_state(files(s, d)).withColumn("line", F.coalesce("line", F.lit(0))),
         q("SELECT file_name, coalesce(line, 0) AS line, severity, snippet FROM v_global_state"))
# a number is kept unless an assignment follows; split at marks so that no match hides another
VIEWS["v_magic0"] = f"""
SELECT file_name, language, string_split(regexp_replace(atext, '\\b({R.MAGIC_VALUES})\\b', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pieces FROM v_files"""
VIEWS["v_magic"] = """
SELECT file_name, language, 'magic' AS pattern_id, 1 + length(array_to_string(pieces[1:k], '')) - length(replace(array_to_string(pieces[1:k], ''), chr(10), '')) AS line,
  split_part(p, chr(2), 1) AS snippet
FROM (SELECT file_name, language, pieces, unnest(pieces[2:]) AS p, unnest(range(1, len(pieces))) AS k FROM v_magic0 WHERE len(pieces) > 1)
WHERE NOT regexp_matches(split_part(p, chr(2), 2), '^\\s*[=:]\\s*[''"\\w\\[]')
  AND NOT (k < len(pieces) - 1 AND regexp_matches(split_part(p, chr(2), 2), '^\\s*[=:]\\s*$'))"""
register("legacy_magic_numbers", lambda s, d: L.magic_numbers(files(s, d)), q("SELECT * FROM v_magic"))
VIEWS["v_catch"] = located_sql([("catch", R.EMPTY_CATCH)])
register("legacy_empty_catch", lambda s, d: L.empty_catch(files(s, d)), q("SELECT * FROM v_catch"))
VIEWS["v_members"] = """
SELECT c.file_name, c.language, c.name AS class_name, c.line, c.bases,
  count(m.line) FILTER (m.kind = 'method') AS methods, count(m.line) FILTER (m.kind = 'property') AS properties,
  count(m.line) FILTER (m.kind = 'field') AS fields, count(m.line) FILTER (m.kind = 'event') AS events,
  count(m.line) AS total_members, count(DISTINCT m.kind) AS member_kinds
FROM (SELECT *, coalesce(lead(line) OVER (PARTITION BY file_name ORDER BY line), 1000000000) AS stop FROM v_symbols WHERE kind = 'class') c
LEFT JOIN v_symbols m ON m.file_name = c.file_name AND m.line > c.line AND m.line < c.stop AND m.kind NOT IN ('class', 'interface')
GROUP BY ALL"""
register("legacy_god_object", lambda s, d: L.god_objects(files(s, d)),
         q("SELECT file_name, class_name, line, methods, methods + properties + fields AS members FROM v_members "
           "WHERE language = 'csharp' AND (methods >= 20 OR methods + properties + fields >= 30)"))
VIEWS["v_dead0"] = f"""
SELECT file_name, regexp_extract_all(regexp_replace(content, {lit('(?m)' + re2(L.METHOD_HEAD))}, '', 'g'), {lit(re2(r'([\w.]+)' + chr(92) + 's*' + chr(92) + '('))}, 1) AS called
FROM v_files WHERE language = 'csharp'"""
VIEWS["v_dead"] = """
SELECT b.file_name, name AS method, line, contains(mods, 'private') AND len(list_filter(called, lambda c: contains(c, name))) = 0 AS unused,
  contains(body, '// TODO') OR contains(body, '// FIXME') OR contains(body, '// HACK') AS marked
FROM v_bodies b JOIN v_dead0 d ON b.file_name = d.file_name WHERE kind = 'method'"""
register("legacy_dead_code", lambda s, d: L.dead_methods(files(s, d)),
         q("SELECT file_name, method, line, 'never called' AS reason FROM v_dead WHERE unused UNION ALL "
           "SELECT file_name, method, line, 'work marker' FROM v_dead WHERE marked"))
VIEWS["v_root"] = """SELECT file_name, split_part(module, '.', 1) AS root, count(*) AS n FROM v_imports WHERE language = 'csharp' GROUP BY ALL"""
VIEWS["v_coupling_file"] = """
SELECT c.file_name, 'file' AS scope, r.roots AS name, c.imports AS n FROM v_counts c
JOIN (SELECT file_name, string_agg(root, ', ' ORDER BY root) AS roots FROM v_root WHERE n > 2 GROUP BY file_name) r ON c.file_name = r.file_name
WHERE c.language = 'csharp' AND c.classes > 3 AND c.imports > c.classes * 2"""
VIEWS["v_coupling_class"] = """
SELECT s.file_name, 'class' AS scope, s.name, len(regexp_extract_all(f.atext, '\\b' || s.name || '\\b')) - 1 AS n
FROM v_symbols s JOIN v_files f ON s.file_name = f.file_name WHERE s.kind = 'class' AND s.language = 'csharp'"""
register("legacy_coupling", lambda s, d: L.coupling(files(s, d)),
         q("SELECT * FROM v_coupling_file UNION ALL SELECT * FROM v_coupling_class WHERE n > 10"))

register("smell_static_cling", lambda s, d: SM.static_cling(files(s, d)),
         q("SELECT * FROM (SELECT file_name, count(*) AS methods, count(*) FILTER (is_static) AS static_methods FROM v_symbols "
           "WHERE language = 'csharp' AND kind = 'method' GROUP BY file_name) WHERE static_methods * 10 > methods * 3"))
VIEWS["v_made"] = """
SELECT file_name, len(list_filter(regexp_extract_all(atext, '\\bnew\\s+([\\w.]+(?:<[^>]*>)?)\\s*[({\\[]', 1),
  lambda t: NOT starts_with(upper(t), 'I') AND NOT regexp_matches(t, 'List|Dictionary|Array|StringBuilder'))) AS creations
FROM v_files WHERE language = 'csharp'"""
register("smell_missing_interfaces", lambda s, d: SM.missing_interfaces(files(s, d)),
         q("""SELECT m.file_name, creations, coalesce(i, 0) AS interfaces, coalesce(c, 0) AS classes FROM v_made m
LEFT JOIN (SELECT file_name, count(*) FILTER (kind = 'interface') AS i, count(*) FILTER (kind = 'class') AS c FROM v_symbols GROUP BY file_name) s
ON m.file_name = s.file_name WHERE creations > 5 AND coalesce(i, 0) < coalesce(c, 0) // 3"""))
VIEWS["v_envy"] = """
SELECT b.file_name, b.owner AS class_name, b.name AS method, b.line,
  CAST(coalesce(sum(CASE WHEN c.line = o.oline THEN len(regexp_extract_all(regexp_replace(body, '[^\\x00-\\x7f]', 'z', 'g'), '\\b' || c.name || '\\b')) END), 0) AS BIGINT) AS own_mentions,
  CAST(coalesce(sum(CASE WHEN c.line <> o.oline THEN len(regexp_extract_all(regexp_replace(body, '[^\\x00-\\x7f]', 'z', 'g'), '\\b' || c.name || '\\b')) END), 0) AS BIGINT) AS other_mentions
FROM v_bodies b JOIN (SELECT file_name, line, max(CASE WHEN kind = 'class' THEN line END) OVER (PARTITION BY file_name ORDER BY line) AS oline FROM v_symbols) o
  ON b.file_name = o.file_name AND b.line = o.line
JOIN v_symbols c ON c.file_name = b.file_name AND c.kind = 'class'
WHERE b.language = 'csharp' AND b.kind = 'method' AND b.owner IS NOT NULL GROUP BY b.file_name, b.owner, b.name, b.line"""
register("smell_feature_envy", lambda s, d: SM.feature_envy(files(s, d)),
         q("SELECT * FROM v_envy WHERE other_mentions > 3 AND other_mentions > own_mentions * 2"))
register("smell_mixed_members", lambda s, d: SM.mixed_members(files(s, d)),
         q("SELECT file_name, class_name, member_kinds, total_members FROM v_members WHERE language = 'csharp' AND member_kinds >= 4 AND total_members > 10"))
register("smell_primitive_params", lambda s, d: SM.primitive_params(files(s, d)),
         q("SELECT * FROM (SELECT file_name, name AS method, line, len(list_filter(string_split(params, ','), "
           "lambda p: regexp_matches(trim(p), '^(string|int|double|decimal|bool)\\s'))) AS n_primitive FROM v_symbols WHERE language = 'csharp' AND kind = 'method') "
           "WHERE n_primitive >= 3"))
register("smell_layer_mix", lambda s, d: SM.layer_mix(files(s, d)),
         q(f"SELECT DISTINCT file_name, owner AS class_name FROM v_bodies WHERE language = 'csharp' AND kind = 'method' "
           f"AND regexp_matches(owner, '(?i){'|'.join(SM.UI_WORDS)}') AND regexp_matches(name || ' ' || body, '(?i){'|'.join(SM.BUSINESS_WORDS)}')"))
VIEWS["v_cls"] = "SELECT file_name, name, line, trim(split_part(bases, ',', 1)) AS base, row_number() OVER (PARTITION BY file_name, name ORDER BY line) AS rn FROM v_symbols WHERE language = 'csharp' AND kind = 'class'"
VIEWS["v_depth"] = """
SELECT file_name, name, line, base, 1 AS depth FROM v_cls
UNION ALL SELECT d.file_name, d.name, d.line, coalesce(c.base, ''), d.depth + 1 FROM v_depth d LEFT JOIN v_cls c ON c.file_name = d.file_name AND c.name = d.base AND c.rn = 1
WHERE d.base <> '' AND d.depth < 50"""
register("smell_deep_inheritance", lambda s, d: SM.inheritance_depth(files(s, d)),
         q("SELECT file_name, name AS class_name, line, CAST(max(depth) AS BIGINT) AS depth FROM v_depth GROUP BY file_name, name, line HAVING max(depth) > 4", recursive=True))

VIEWS["v_all_lines"] = ("SELECT file_name, language, u.line AS line, u.text AS text, u.a AS atext FROM (SELECT file_name, language, "
                        "unnest(list_transform(string_split(content, chr(10)), lambda x, i: {'line': i, 'text': x, 'a': regexp_replace(x, '[^\\x00-\\x7f]', 'z', 'g')})) AS u FROM v_all_files)")


def _line_sql() -> str:
    parts = [f"SELECT file_name, language, line, trim(text) AS snippet, '{k}' AS pattern_type, {str(dep).lower()} AS is_deprecated "
             f"FROM v_all_lines WHERE language = '{lang}' AND regexp_matches(atext, {lit(p)})" for lang, k, p, dep in R.LINE_PATTERNS]
    cb = " + ".join(n_of("atext", p, "") for p in R.CALLBACK_MARKS)
    parts.append(f"SELECT file_name, language, line, trim(text), 'CallbackHell', false FROM v_all_lines WHERE language = 'javascript' AND ({cb}) >= 3")
    parts.append(f"SELECT file_name, language, line, trim(text), 'MissingErrorHandling', false FROM v_all_lines WHERE language = 'go' "
                 f"AND regexp_matches(atext, {lit(R.GO_CALL_END)}) AND NOT contains(text, 'if err') AND NOT contains(text, 'err :=') "
                 "AND (contains(text, 'err') OR contains(text, 'error'))")
    return " UNION ALL ".join(parts)


VIEWS["v_line_patterns"] = _line_sql()
register("line_patterns", lambda s, d: SM.line_patterns(_all_files(s, d)), q("SELECT * FROM v_line_patterns"))


def _semantic(s, d):
    from ..operators import parse as P
    issues = P.parse_semantic_issues(V.responses(s, d)).withColumnRenamed("expected_file", "file_name")
    patterns = SM.line_patterns(_all_files(s, d)).select(
        F.concat(F.regexp_extract("file_name", r"(Unit\d+)_", 1), F.lit(".cs")).alias("file_name"), "is_deprecated")
    return SM.semantic_quality(issues.select("file_name", "severity"), patterns)


register("semantic_quality", _semantic,
         q("""SELECT file_name, least(greatest(100 - CAST(sum(cost) AS BIGINT), 0), 100) AS quality FROM (
SELECT expected_file AS file_name, conv_id % 5 * 5 AS cost FROM v_responses WHERE shape IN (0, 1) UNION ALL
SELECT regexp_extract(file_name, '(Unit\\d+)_', 1) || '.cs', 10 FROM v_line_patterns WHERE is_deprecated) GROUP BY file_name"""))
