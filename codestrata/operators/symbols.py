r"""Symbol, import and container tables from per-language line patterns.

A file is one row and stays one row until its marks are known: line split,
declaration test, owner and extent are array expressions, so no shuffle is
needed and ``content`` never leaves the scan stage. The patterns are
heuristic (they see lines, not scopes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import finds_sql, jre, pin, split_lines, sql_text

_MODS = r"(?:public|private|protected|internal|static|abstract|sealed|partial|final|export|default|async|virtual|override)"
JS_KEYWORDS = ["if", "for", "while", "switch", "catch", "function", "return", "else", "do", "with"]

# (kind, pattern, {field: group}); the first pattern that fits a line wins
_C_FAMILY = [
    ("class", rf"^\s*((?:{_MODS}\s+)*)class\s+(\w+)", {"mods": 1, "name": 2}),
    ("interface", rf"^\s*((?:{_MODS}\s+)*)interface\s+(\w+)", {"mods": 1, "name": 2}),
    ("event", rf"^\s*((?:{_MODS}\s+)*)event\s+([\w<>.]+)\s+(\w+)\s*;", {"mods": 1, "rtype": 2, "name": 3}),
    ("method", rf"^\s*(?:\[[^\]]*\]\s*)*((?:{_MODS}\s+)+)([\w<>\[\],.?]+)\s+(\w+)\s*\(([^)]*)\)",
     {"mods": 1, "rtype": 2, "name": 3, "params": 4}),
    ("property", rf"^\s*((?:{_MODS}\s+)+)([\w<>\[\],.?]+)\s+(\w+)\s*\{{([^}}]*(?:get|set)[^}}]*)",
     {"mods": 1, "rtype": 2, "name": 3, "params": 4}),
    ("field", r"^\s*((?:(?:public|private|protected|internal|static|readonly|const|final)\s+)+)([\w<>\[\],.?]+)\s+(\w+)\s*(?:=[^>].*)?;",
     {"mods": 1, "rtype": 2, "name": 3}),
]
_JS = [
    ("class", r"^\s*((?:(?:export|default|abstract)\s+)*)class\s+(\w+)", {"mods": 1, "name": 2}),
    ("interface", r"^\s*((?:export\s+)?)interface\s+(\w+)", {"mods": 1, "name": 2}),
    ("method", r"^\s*((?:(?:export|default|async|static|public|private|protected)\s+)*)(?:function\s+)?(\w+)\s*\(([^)]*)\)\s*(?::\s*([\w<>\[\]|]+)\s*)?\{",
     {"mods": 1, "name": 2, "params": 3, "rtype": 4}),
]
GRAMMAR = {
    "csharp": _C_FAMILY,
    "java": _C_FAMILY,
    "javascript": _JS,
    "typescript": _JS,
    "python": [
        ("class", r"^\s*()class\s+(\w+)", {"mods": 1, "name": 2}),
        ("method", r"^\s*((?:async\s+)?)def\s+(\w+)\s*\(([^)]*)", {"mods": 1, "name": 2, "params": 3}),
    ],
    "go": [
        ("class", r"^()type\s+(\w+)\s+struct", {"mods": 1, "name": 2}),
        ("method", r"^func\s+(?:\(\w+\s+\*?(\w+)\)\s*)?(\w+)\s*\(([^)]*)\)", {"recv": 1, "name": 2, "params": 3}),
    ],
}
BASES = {
    "csharp": [r"class\s+\w+\s*(?:<[^>]*>)?\s*:\s*([^{]+)"],
    "java": [r"extends\s+([\w.]+)", r"implements\s+([\w., ]+)"],
    "javascript": [r"extends\s+([\w.]+)", r"implements\s+([\w., ]+)"],
    "typescript": [r"extends\s+([\w.]+)", r"implements\s+([\w., ]+)"],
    "python": [r"class\s+\w+\s*\(([^)]*)\)"],
    "go": [],
}
# (pattern, module groups, wildcard pattern)
IMPORTS = {
    "csharp": (r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", [1], r"^\s*using\s+static\s"),
    "python": (r"^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w.*]+)", [1, 2], r"import\s+\*"),
    "java": (r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", [1], r"\.\*\s*;"),
    "javascript": (r"""^\s*(?:import\s.*|.*require\s*\(\s*)["'`]([^"'`]+)["'`]""", [1], r"import\s+\*"),
    "go": (r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$""", [1], r"^\s*(?:import\s+)?\.\s"),
}
IMPORTS["typescript"] = IMPORTS["javascript"]
CONTAINERS = {"csharp": r"^\s*namespace\s+([\w.]+)", "java": r"^\s*package\s+([\w.]+)", "go": r"^\s*package\s+(\w+)"}
# cheap line tests every pattern of the language implies
GATES = {
    "csharp": r"x RLIKE '^\\s*(?:\\[|public|private|protected|internal|static|abstract|sealed|partial|final|export|default|async|virtual|override|readonly|const|class|interface|event)'",
    "javascript": "contains(x, '{') OR contains(x, 'class') OR contains(x, 'interface')",
    "python": "contains(x, 'class') OR contains(x, 'def')",
    "go": "startswith(x, 'type') OR startswith(x, 'func')",
}
GATES["java"], GATES["typescript"] = GATES["csharp"], GATES["javascript"]
FIELDS = ["mods", "rtype", "name", "params", "recv"]


def _bases_sql(lang: str) -> str:
    parts = ", ".join(f"nullif(trim(regexp_extract(x, {sql_text(jre(p, ''))}, 1)), '')" for p in BASES[lang])
    return f"concat_ws(', ', {parts})" if parts else "''"


def _mark_sql(lang: str) -> str:
    """CASE over the language's declarations, for a lambda (x, i) over the line array."""
    cases = []
    for kind, pattern, groups in GRAMMAR[lang]:
        p = sql_text(jre(pattern, ""))
        cond = f"x RLIKE {p}"
        if lang in ("javascript", "typescript") and kind == "method":
            words = ", ".join(sql_text(w) for w in JS_KEYWORDS)
            cond += f" AND regexp_extract(x, {p}, {groups['name']}) NOT IN ({words})"
        fields = ", ".join(f"'{f}', regexp_extract(x, {p}, {groups[f]})" if f in groups else f"'{f}', ''" for f in FIELDS)
        bases = _bases_sql(lang) if kind == "class" else "''"
        cases.append(f"WHEN {cond} THEN named_struct('line', i + 1, 'kind', '{kind}', {fields}, 'bases', {bases})")
    return f"CASE WHEN {GATES[lang]} THEN CASE " + " ".join(cases) + " END END"


def _per_language(bodies: dict[str, str], otherwise: str = "") -> Column:
    same: dict[str, list[str]] = {}
    for lang, body in bodies.items():
        same.setdefault(body, []).append(lang)
    cases = " ".join(f"WHEN language IN ({', '.join(sql_text(x) for x in langs)}) THEN {body}" for body, langs in same.items())
    return F.expr(f"CASE {cases} {'ELSE ' + otherwise if otherwise else ''} END")


def _marks() -> Column:
    return _per_language({lang: f"filter(transform(lines, (x, i) -> {_mark_sql(lang)}), m -> m IS NOT NULL)" for lang in GRAMMAR})


def file_lines(files: DataFrame) -> DataFrame:
    return files.select("file_name", "language", split_lines(F.col("content")).alias("lines"))


def with_marks(files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per file with its line array and its array of declarations."""
    base = files.select("file_name", "language", *(extra or []), split_lines(F.col("content")).alias("lines"))
    return pin(base, _marks().alias("marks"))


def _next_line(i: Column) -> Column:
    return F.coalesce(F.get(F.col("marks"), i + 1)["line"], F.size("lines") + 1)


def body_of(m: Column, i: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), m["line"], _next_line(i) - m["line"]), "\n")


def extract_symbols(files: DataFrame, kind: str | None = None, with_body: bool = False) -> DataFrame:
    """One row per declaration. ``body`` runs to the line before the next declaration."""
    base = with_marks(files).withColumn("classes", F.filter("marks", lambda m: m["kind"] == "class"))

    def full(m: Column, i: Column) -> Column:
        nxt = _next_line(i)
        owner = owner_of(m)
        cols = [m[f].alias(f) for f in ["line", "kind", "name", "mods", "rtype", "params", "bases"]]
        cols += [owner.alias("owner"), nxt.alias("next_line")]
        if with_body:
            cols.append(body_of(m, i).alias("body"))
        return F.struct(*cols)

    out = base.select("file_name", "language", F.inline(F.transform("marks", full)))
    out = out.withColumn("access", F.regexp_extract("mods", r"\b(public|private|protected|internal)\b", 1))
    out = out.withColumn("is_static", F.col("mods").contains("static")).withColumn("is_async", F.col("mods").contains("async"))
    return out.where(F.col("kind") == kind) if kind else out


def extract_imports(files: DataFrame) -> DataFrame:
    bodies = {}
    for lang, (pattern, groups, wild) in IMPORTS.items():
        p = sql_text(jre(pattern, ""))
        module = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, {p}, {g}), '')" for g in groups) + ", '')"
        bodies[lang] = (f"filter(transform(lines, (x, i) -> CASE WHEN {finds_sql('x', 'x', pattern, '')} THEN named_struct('line', i + 1, 'module', {module}, "
                        f"'is_wildcard', x RLIKE {sql_text(jre(wild, ''))}) END), m -> m IS NOT NULL)")
    return file_lines(files).select("file_name", "language", F.inline(_per_language(bodies)))


def container_of() -> Column:
    """First namespace or package name; empty where the language has none."""
    return _per_language({lang: f"regexp_extract(content, {sql_text(jre(p, 'm'))}, 1)" for lang, p in CONTAINERS.items()}, "''")


def extract_container(files: DataFrame) -> DataFrame:
    return files.select("file_name", "language", container_of().alias("container"))


def explode_lines(files: DataFrame) -> DataFrame:
    lines = files.select("file_name", "language", F.posexplode(split_lines(F.col("content"))).alias("pos", "text"))
    return lines.select("file_name", "language", (F.col("pos") + 1).alias("line"), "text")


def _count_marks(marks: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(marks, lambda m: m["kind"] == kind)), F.lit(0))


#: Kinds of a table of symbols that count as classes.
CLASS_KINDS = ["class", "struct", "record"]


def file_counts(files: DataFrame, extra: list[str] | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Class, method, property and import counts per file, in one pass and no shuffle.

    With ``symbols`` (by blocks, or by extractors of one's own) declarations are counted from that table.
    """
    imports = _per_language({lang: f"size(filter(lines, x -> {finds_sql('x', 'x', p, '')}))" for lang, (p, _, _) in IMPORTS.items()}, "0")
    if symbols is not None:
        kinds = {"classes": F.col("kind").isin(CLASS_KINDS), "methods": F.col("kind") == "method", "properties": F.col("kind") == "property"}
        counts = symbols.groupBy("file_name").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
        slim = files.select("file_name", "language", *(extra or []), split_lines(F.col("content")).alias("lines"))
        slim = slim.select("file_name", "language", *(extra or []), imports.alias("imports"), F.size("lines").alias("loc"))
        return slim.join(counts, "file_name", "left").select(
            "file_name", "language", *(extra or []), *[F.coalesce(n, F.lit(0)).alias(n) for n in kinds], "imports", "loc")
    return with_marks(files, extra).select(
        "file_name", "language", *(extra or []),
        _count_marks(F.col("marks"), "class").alias("classes"), _count_marks(F.col("marks"), "method").alias("methods"),
        _count_marks(F.col("marks"), "property").alias("properties"), imports.alias("imports"),
        F.size("lines").alias("loc"),
    )


def signature_text(m, owner: Column) -> Column:
    """Readable signature of a declaration; ``m`` maps field names to columns."""
    access = F.regexp_extract(m["mods"], r"\b(public|private|protected|internal)\b", 1)
    mods = F.concat_ws(" ", F.when(access != "", access), F.when(m["mods"].contains("static"), F.lit("static")),
                       F.when(m["mods"].contains("async"), F.lit("async")))
    owned = F.concat(F.coalesce(F.concat(owner, F.lit(".")), F.lit("")), m["name"])
    accessors = F.concat(F.when(m["params"].contains("get"), "get; ").otherwise(""), F.when(m["params"].contains("set"), "set; ").otherwise(""))
    return (
        F.when(m["kind"] == "class", F.concat(access, F.lit(" class "), m["name"],
               F.when(m["bases"] != "", F.concat(F.lit(" : "), m["bases"])).otherwise("")))
        .when(m["kind"] == "method", F.concat(mods, F.lit(" "), F.when(m["rtype"] != "", m["rtype"]).otherwise("void"),
              F.lit(" "), owned, F.lit("("), F.trim(m["params"]), F.lit(")")))
        .when(m["kind"] == "property", F.concat(access, F.lit(" "), m["rtype"], F.lit(" "), owned, F.lit(" { "), accessors, F.lit("}")))
    )


def owner_of(m: Column) -> Column:
    """Last class declared at or above the line; needs a ``classes`` column."""
    last = F.try_element_at(F.filter("classes", lambda c: c["line"] <= m["line"]), F.lit(-1))["name"]
    return F.when(m["kind"] == "class", F.lit(None)).when(m["recv"] != "", m["recv"]).otherwise(last)


def signatures(symbols: DataFrame) -> DataFrame:
    """Readable class, method and property signatures."""
    fields = {c: F.col(c) for c in ["kind", "name", "mods", "rtype", "params", "bases"]}
    return symbols.where(F.col("kind").isin("class", "method", "property")).select(
        "file_name", "kind", "line", signature_text(fields, F.col("owner")).alias("signature"))
