r"""Legacy scan: located matches, oversized classes, dead code, coupling.

``match_lines`` tags newlines and matches in one token stream per pattern: a
zero-width look-ahead keeps line breaks inside a match countable. The line of
the m-th match token at position i is ``i - m + 1``: linear, inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..data import rules as R
from ..functions.text import finds_sql, jre, low_text, sql_text, unify_newlines
from .symbols import _MODS, body_of, with_marks


METHOD_HEAD = rf"^\s*(?:\[[^\]]*\]\s*)*(?:{_MODS}\s+)+[\w<>\[\],.?]+\s+\w+\s*\("


def _located_sql(pattern: str, pattern_id: str, flags: str) -> str:
    token = sql_text(jre(rf"\n|(?=({pattern}))", flags))
    tokens = f"transform(regexp_extract_all(_t, {token}, 1), (x, i) -> named_struct('i', i, 'snippet', x))"
    rows = (f"transform(filter({tokens}, t -> t.snippet <> ''), (t, m) -> named_struct('pattern_id', {sql_text(pattern_id)}, "
            f"'line', t.i - m + 1, 'snippet', t.snippet))")
    return f"CASE WHEN {finds_sql('_t', '_low', pattern, flags)} THEN {rows} END"


def match_lines(files: DataFrame, patterns: list[tuple[str, str]], flags: str = "i") -> DataFrame:
    """Every match of every pattern, with line number and text; matches may span lines."""
    text = unify_newlines(F.col("content"))
    hits = F.expr(f"flatten(array_compact(array({', '.join(_located_sql(p, pid, flags) for pid, p in patterns)})))")
    d = files.select("file_name", "language", text.alias("_t"), low_text(text).alias("_low"))
    return d.select("file_name", "language", F.inline(hits))


def numbered(prefix: str, patterns: list[str]) -> list[tuple[str, str]]:
    return [(f"{prefix}{i:02d}", p) for i, p in enumerate(patterns, 1)]


def obsolete_api(files: DataFrame) -> DataFrame:
    return match_lines(files, numbered("api", R.OBSOLETE_API))


def global_state_matches(files: DataFrame) -> DataFrame:
    return match_lines(files, numbered("gs", R.GLOBAL_STATE))


def global_state(files: DataFrame) -> DataFrame:
    """C#: first use of the request-context global and more than three public static fields; others: pattern matches."""
    cs = files.where(F.col("language") == "csharp")
    other = global_state_matches(files.where(F.col("language") != "csharp")).select(
        "file_name", "line", F.lit("Medium").alias("severity"), "snippet")
    text = unify_newlines(F.col("content"))
    # text before the first use decides its line
    before = F.substring_index(text, "HttpContext.Current", 1)
    first = cs.where(F.col("content").contains("HttpContext.Current")).select(
        "file_name", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"),
        F.lit("High").alias("severity"), F.lit("HttpContext.Current").alias("snippet"))
    statics = F.filter("marks", lambda m: (m["kind"] == "field") & m["mods"].contains("static") & m["mods"].contains("public"))
    many = with_marks(cs).select("file_name", statics.alias("s")).where(F.size("s") > 3).select(
        "file_name", F.lit(None).cast("int").alias("line"), F.lit("Medium").alias("severity"),
        F.array_join(F.transform("s", lambda m: m["name"]), ", ").alias("snippet"))
    return other.unionByName(first).unionByName(many)


def magic_numbers(files: DataFrame) -> DataFrame:
    return match_lines(files, [("magic", R.MAGIC_NUMBER)])


def empty_catch(files: DataFrame) -> DataFrame:
    return match_lines(files, [("catch", R.EMPTY_CATCH)])


def class_members(files: DataFrame) -> DataFrame:
    """One row per class with its member counts, from the file's own declaration array."""
    def members(c: Column) -> Column:
        later = F.filter("marks", lambda m: (m["kind"] == "class") & (m["line"] > c["line"]))
        stop = F.coalesce(F.array_min(F.transform(later, lambda m: m["line"])), F.lit(2147483647))
        return F.filter("marks", lambda m: (m["line"] > c["line"]) & (m["line"] < stop)
                        & ~m["kind"].isin("class", "interface"))

    def row(c: Column) -> Column:
        return F.struct(c["name"].alias("class_name"), c["line"].alias("line"), c["bases"].alias("bases"), members(c).alias("members"))

    classes = F.filter("marks", lambda m: m["kind"] == "class")
    df = with_marks(files).select("file_name", "language", F.inline(F.transform(classes, row)))

    def n(kind: str) -> Column:
        return F.size(F.filter("members", lambda m: m["kind"] == kind))

    return df.select(
        "file_name", "language", "class_name", "line", "bases", n("method").alias("methods"), n("property").alias("properties"),
        n("field").alias("fields"), n("event").alias("events"), F.size("members").alias("total_members"),
        F.size(F.array_distinct(F.transform("members", lambda m: m["kind"]))).alias("member_kinds"))


def god_objects(files: DataFrame, min_methods: int = 20, min_members: int = 30) -> DataFrame:
    m = class_members(files.where(F.col("language") == "csharp"))
    total = F.col("methods") + F.col("properties") + F.col("fields")
    return m.where((F.col("methods") >= min_methods) | (total >= min_members)).select(
        "file_name", "class_name", "line", "methods", total.alias("members"))


def dead_methods(files: DataFrame) -> DataFrame:
    """Private methods never named in a call of their file, and methods holding work markers."""
    cs = files.where(F.col("language") == "csharp")
    # heads of declarations are taken out first, so what is left before "(" is a call
    bare = F.regexp_replace(F.col("content"), jre(METHOD_HEAD, "m"), "")
    called = F.regexp_extract_all(bare, F.lit(jre(r"([\w.]+)\s*\(", "")), F.lit(1))

    def row(m: Column, i: Column) -> Column:
        body = body_of(m, i)
        return F.struct(m["name"].alias("method"), m["line"].alias("line"), m["kind"].alias("kind"),
                        (m["mods"].contains("private") & ~F.exists("called", lambda c: c.contains(m["name"]))).alias("unused"),
                        (body.contains("// TODO") | body.contains("// FIXME") | body.contains("// HACK")).alias("marked"))

    df = with_marks(cs, ["content"]).withColumn("called", called).select("file_name", F.inline(F.transform("marks", row)))
    df = df.where((F.col("kind") == "method") & (F.col("unused") | F.col("marked")))
    reasons = F.array_compact(F.array(F.when(F.col("unused"), F.lit("never called")), F.when(F.col("marked"), F.lit("work marker"))))
    return df.select("file_name", "method", "line", F.explode(reasons).alias("reason"))


def coupling(files: DataFrame) -> DataFrame:
    """File level: many imports per class from one root; class level: more than ten self mentions."""
    cs = files.where(F.col("language") == "csharp")
    uses = F.filter(F.transform("lines", lambda x: F.regexp_extract(x, jre(r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", ""), 1)),
                    lambda x: x != "")
    base = with_marks(cs, ["content"]).withColumn("uses", uses)
    classes = F.filter("marks", lambda m: m["kind"] == "class")
    roots = F.transform("uses", lambda u: F.substring_index(u, ".", 1))
    frequent = F.filter(F.array_sort(F.array_distinct("roots")), lambda r: F.size(F.filter("roots", lambda x: x == r)) > 2)
    wide = base.withColumn("roots", roots).select("file_name", classes.alias("cls"), "uses", frequent.alias("frequent")).where(
        (F.size("cls") > 3) & (F.size("uses") > F.size("cls") * 2) & (F.size("frequent") > 0))
    wide = wide.select("file_name", F.lit("file").alias("scope"), F.array_join("frequent", ", ").alias("name"),
                       F.size("uses").cast("int").alias("n"))
    # mentions other than the declaration itself
    def mentions(c: Column) -> Column:
        n = F.size(F.split(F.col("content"), F.concat(F.lit(r"\b"), c["name"], F.lit(r"\b")), -1)) - 2
        return F.struct(F.lit("class").alias("scope"), c["name"].alias("name"), n.cast("int").alias("n"))

    selfish = base.select("file_name", F.inline(F.transform(classes, mentions))).where(F.col("n") > 10)
    return wide.unionByName(selfish)
