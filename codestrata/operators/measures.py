"""Per-file measures: pure column expressions over counts and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..data import rules as R
from ..functions.text import any_of, clamp, finds, finds_sql, jre, low_text, n_of, pin, split_lines, sql_text
from .rulescan import _hits
from .symbols import IMPORTS, _per_language, body_of, container_of, extract_symbols, owner_of, signature_text, with_marks

# --- fixed values: function start and boundary lines ------------------------
PY_START, PY_END = r"^\s*def\s+\w+", r"^\s*(def|class)\s+"
X_START, X_END = r"^\s*(function|public|private|func|def)\s+\w+", r"^\s*(function|public|private|func|def|class|})\s*"
LONG_FUNCTION = 50


def cyclomatic(files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Decision keywords + 1; for C# every method adds 1 and only method bodies count."""
    def step(m: Column, i: Column) -> Column:
        return F.when(m["kind"] == "method", n_of(body_of(m, i), R.DECISIONS_CSHARP, "") + 1).otherwise(F.lit(0))

    methods = F.aggregate(F.transform("marks", step), F.lit(0), lambda a, x: a + x)
    value = F.when(F.col("language") == "csharp", methods).otherwise(n_of(F.col("content"), R.DECISIONS, "") + 1)
    out = pin(with_marks(files, ["content", *(extra or [])]), F.greatest(F.lit(1), F.coalesce(value, F.lit(1))).alias("cyclomatic"))
    return out.select("file_name", "language", *(extra or []), F.size("lines").alias("loc"), "cyclomatic")


def file_complexity(classes: Column, methods: Column, imports: Column) -> Column:
    return clamp(classes * 10 + methods * 2 + imports, 0, 100)


def report_complexity(classes: Column, methods: Column, imports: Column) -> Column:
    return clamp(F.floor((classes * 3 + methods + imports * 2) / 2), 0, 100)


def page_complexity(classes: Column, methods: Column, imports: Column) -> Column:
    return clamp(F.floor((classes * 10 + methods * 2 + imports * 3) / 5), 0, 100)


def function_length(files: DataFrame) -> DataFrame:
    """Lines from a function start to the next boundary line (or end of file)."""
    def spans(start: str, end: str) -> Column:
        starts = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(jre(start, "")), i + 1)), lambda v: v.isNotNull())
        ends = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(jre(end, "")), i + 1)), lambda v: v.isNotNull())
        # a start is itself a boundary, so the next boundary is the one after it in the sorted array
        return F.transform(starts, lambda s: F.struct(
            s.cast("int").alias("line"),
            (F.coalesce(F.get(ends, F.array_position(ends, s).cast("int")), F.size("lines") + 1) - s).cast("int").alias("length")))

    py = spans(PY_START, PY_END)
    shared = spans(X_START, X_END)
    out = files.where(F.col("language").isin("python", *R.SHARED)).select(
        "file_name", "language", split_lines(F.col("content")).alias("lines"))
    out = out.select("file_name", "language", F.inline(F.when(F.col("language") == "python", py).otherwise(shared)))
    cs = extract_symbols(files.where(F.col("language") == "csharp"), "method").select(
        "file_name", "language", "line", (F.col("next_line") - F.col("line")).alias("length"))
    return out.unionByName(cs).withColumn("is_long", F.col("length") > LONG_FUNCTION)


def legacy_age(files: DataFrame, as_of: str) -> DataFrame:
    years = F.datediff(F.lit(as_of).cast("date"), F.col("last_modified")) / F.lit(365.0)
    return files.withColumn("_low", low_text(F.col("content"))).select(
        "file_name", years.cast("int").alias("age_years"), (years > 5).alias("is_very_old"),
        any_of([finds(F.col("content"), F.col("_low"), p) for p in R.ANCIENT_FRAMEWORK]).alias("is_ancient"))


def _modules() -> Column:
    bodies = {}
    for lang, (pattern, groups, _) in IMPORTS.items():
        p = sql_text(jre(pattern, ""))
        module = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, {p}, {g}), '')" for g in groups) + ", '')"
        bodies[lang] = f"filter(transform(lines, x -> CASE WHEN {finds_sql('x', 'x', pattern, '')} THEN {module} END), m -> m IS NOT NULL)"
    return _per_language(bodies, "cast(array() as array<string>)")


def file_profile(files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Everything the summary needs, per file and in one pass: imports, signatures, hits, measures."""
    def step(m: Column, i: Column) -> Column:
        return F.when(m["kind"] == "method", n_of(body_of(m, i), R.DECISIONS_CSHARP, "") + 1).otherwise(F.lit(0))

    d = with_marks(files, ["content", "size", *(extra or [])]).withColumn("_low", low_text(F.col("content")))
    d = d.withColumn("classes", F.coalesce(F.filter("marks", lambda m: m["kind"] == "class"), F.expr("slice(marks, 1, 0)")))

    def sigs(kind: str) -> Column:
        texts = F.transform(F.filter("marks", lambda m: m["kind"] == kind), lambda m: signature_text(m, owner_of(m)))
        return F.coalesce(texts, F.array().cast("array<string>"))

    methods = F.aggregate(F.transform("marks", step), F.lit(0), lambda a, x: a + x)
    cyc = F.when(F.col("language") == "csharp", methods).otherwise(n_of(F.col("content"), R.DECISIONS, "") + 1)
    d = pin(d, F.greatest(F.lit(1), F.coalesce(cyc, F.lit(1))).alias("cyclomatic"), _hits(R.ALL_RULES).alias("hits"), _modules().alias("modules"),
            container_of().alias("container"), sigs("class").alias("class_sigs"), sigs("method").alias("method_sigs"),
            sigs("property").alias("property_sigs"))
    return d.select("file_name", "language", "size", *(extra or []), F.size("lines").alias("loc"), F.length("content").alias("code_len"),
                    "cyclomatic", F.coalesce("hits", F.expr("slice(hits, 1, 0)")).alias("hits"), "modules", "container", "class_sigs", "method_sigs", "property_sigs")


def _capped(arr: Column, n: int, sep: str) -> Column:
    return F.concat(F.array_join(F.slice(arr, 1, n), sep), F.when(F.size(arr) > n, sep + "...").otherwise(""))


def summary_text() -> Column:
    """The capped text of one profile row."""
    lines = [F.concat(F.lit("File: "), F.col("file_name"), F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes) | Language: "), F.col("language"))]
    for label, col, n, sep in [("Imports/Dependencies: ", F.col("modules"), 8, ", "), ("Classes/Types: ", F.col("class_sigs"), 6, " | "),
                               ("Methods/Functions: ", F.col("method_sigs"), 10, " | ")]:
        lines.append(F.when(F.size(col) > 0, F.concat(F.lit(label), _capped(col, n, sep))))
        if label.startswith("Imports"):
            lines.append(F.when(F.col("container") != "", F.concat(F.lit("Namespaces/Modules: "), F.col("container"))))
    families = [("Security Risks", "security"), ("Performance Issues", "performance"), ("Architecture Concerns", "architecture")]

    def family(fam: str) -> Column:
        picked = F.filter("hits", lambda h: h["family"] == fam)
        return F.coalesce(F.transform(picked, lambda h: F.concat(F.lit("["), h["severity"], F.lit("] "), h["rule_id"])), F.array().cast("array<string>"))

    for label, fam in families:
        arr = family(fam)
        lines.append(F.when(F.size(arr) > 0, F.concat(F.lit(f"{label} ("), F.size(arr).cast("string"), F.lit("): "), _capped(arr, 5, "; "))))
    lines.append(F.when(F.coalesce(F.size("hits"), F.lit(0)) <= 0, F.lit("Pattern Analysis: No critical patterns detected.")))
    lines.append(F.concat(F.lit("Complexity: CC="), F.col("cyclomatic").cast("string"), F.lit(", LOC="), F.col("loc").cast("string"), F.lit(", Classes="),
                          F.size("class_sigs").cast("string"), F.lit(", Methods="), F.size("method_sigs").cast("string")))
    return F.concat_ws("\n", *lines)


def file_summary(files: DataFrame) -> DataFrame:
    return file_profile(files).select("file_name", summary_text().alias("summary"))


def project_metadata(files: DataFrame, max_namespaces: int = 10, max_dependencies: int = 20) -> DataFrame:
    """Namespaces, outside dotted dependencies and line total of the C# files of a project."""
    cs = files.where(F.lower("file_name").endswith(".cs"))
    found = F.concat(
        F.transform(F.regexp_extract_all("content", F.lit(jre(r"namespace\s+([^\s{;]+)", "")), F.lit(1)), lambda x: F.struct(F.lit("ns").alias("what"), x.alias("name"))),
        F.transform(F.filter(F.transform(F.regexp_extract_all("content", F.lit(jre(r"using\s+([^;]+);", "")), F.lit(1)), lambda x: F.trim(x)),
                             lambda x: ~x.startswith("System") & x.contains(".")), lambda x: F.struct(F.lit("dep").alias("what"), x.alias("name"))))
    names = cs.select("project", F.inline(F.array_distinct(found))).distinct()
    w = W.partitionBy("project", "what").orderBy("name")
    # the plain rank filter is applied per task before the shuffle
    top = names.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(max_namespaces, max_dependencies)).where(
        ((F.col("what") == "ns") & (F.col("rn") <= max_namespaces)) | ((F.col("what") == "dep") & (F.col("rn") <= max_dependencies)))

    def joined(what: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.col("name")))), ", ").alias(what)

    lists = top.groupBy("project").agg(joined("ns"), joined("dep"))
    totals = cs.groupBy("project").agg(F.sum(F.size(split_lines(F.col("content")))).alias("total_lines"))
    solution = files.where(F.lower("file_name").endswith(".sln") | F.lower("file_name").endswith(".csproj")).groupBy("project").agg(
        F.min(F.struct(F.lower("file_name").endswith(".csproj").alias("k"), F.col("file_name").alias("f"))).alias("s"))
    return totals.join(lists, "project", "left").join(solution, "project", "left").select(
        "project", F.coalesce(F.regexp_replace(F.col("s.f"), r"^.*/|\.[^.]*$", ""), F.lit("")).alias("solution"),
        F.coalesce("ns", F.lit("")).alias("namespaces"), F.coalesce("dep", F.lit("")).alias("dependencies"), "total_lines")
