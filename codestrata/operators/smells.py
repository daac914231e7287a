"""C# design smells, each from the file's own declaration array (no self-join, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..data import rules as R
from ..functions.text import any_of, contains_ci, jre, n_of
from .legacy import class_members
from .symbols import body_of, explode_lines, with_marks

# --- fixed values ------------------------------------------------------------
COLLECTION_WORDS = ["List", "Dictionary", "Array", "StringBuilder"]
PRIMITIVES = ["string", "int", "double", "decimal", "bool"]
UI_WORDS = ["Page", "Controller", "View", "Razor", "Component", "Form", "UserControl"]
BUSINESS_WORDS = ["Calculate", "Process", "Validate", "Business", "Service", "Repository", "DataAccess"]
MAX_DEPTH_STEPS = 64


def _cs(files: DataFrame) -> DataFrame:
    return files.where(F.col("language") == "csharp")


def _kind(kind: str) -> Column:
    return F.filter("marks", lambda m: m["kind"] == kind)


def static_cling(files: DataFrame) -> DataFrame:
    methods = _kind("method")
    df = with_marks(_cs(files)).select(
        "file_name", F.size(methods).alias("methods"), F.size(F.filter(methods, lambda m: m["mods"].contains("static"))).alias("static_methods"))
    return df.where((F.col("methods") > 0) & (F.col("static_methods") * 10 > F.col("methods") * 3))


def missing_interfaces(files: DataFrame) -> DataFrame:
    made = F.regexp_extract_all("content", F.lit(jre(r"\bnew\s+([\w.]+(?:<[^>]*>)?)\s*[({\[]", "")), F.lit(1))
    concrete = F.filter(made, lambda t: ~F.upper(t).startswith("I") & ~any_of([t.contains(w) for w in COLLECTION_WORDS]))
    df = with_marks(_cs(files), ["content"]).select(
        "file_name", F.size(concrete).alias("creations"), F.size(_kind("interface")).alias("interfaces"), F.size(_kind("class")).alias("classes"))
    return df.where((F.col("creations") > 5) & (F.col("interfaces") < F.floor(F.col("classes") / 3)))


def _mentions(text: Column, name: Column) -> Column:
    return F.size(F.split(text, F.concat(F.lit(r"\b"), name, F.lit(r"\b")), -1)) - 1


def feature_envy(files: DataFrame) -> DataFrame:
    """Methods that name other classes of the file more than three times and over twice their own."""
    classes = _kind("class")
    df = with_marks(_cs(files)).withColumn("classes", classes)

    def row(m: Column, i: Column) -> Column:
        own = F.try_element_at(F.filter("classes", lambda c: c["line"] <= m["line"]), F.lit(-1))
        body = body_of(m, i)
        others = F.aggregate(F.filter("classes", lambda c: c["line"] != own["line"]), F.lit(0),
                             lambda a, c: a + _mentions(body, c["name"]))
        return F.struct(m["kind"].alias("kind"), own["name"].alias("class_name"), m["name"].alias("method"),
                        m["line"].alias("line"), _mentions(body, own["name"]).alias("own_mentions"), others.alias("other_mentions"))

    # only files with two classes can show the smell
    out = df.where(F.size("classes") > 1).select("file_name", F.inline(F.transform("marks", row)))
    return out.where((F.col("kind") == "method") & F.col("class_name").isNotNull() & (F.col("other_mentions") > 3)
                     & (F.col("other_mentions") > F.col("own_mentions") * 2)).drop("kind")


def mixed_members(files: DataFrame) -> DataFrame:
    return class_members(_cs(files)).where((F.col("member_kinds") >= 4) & (F.col("total_members") > 10)).select(
        "file_name", "class_name", "member_kinds", "total_members")


def primitive_params(files: DataFrame) -> DataFrame:
    """Methods with three or more parameters of a primitive type."""
    def n(m: Column) -> Column:
        types = F.transform(F.split(m["params"], ","), lambda p: F.regexp_extract(F.trim(p), r"^(\S+)\s", 1))
        return F.size(F.filter(types, lambda t: t.isin(PRIMITIVES)))

    rows = F.transform(_kind("method"), lambda m: F.struct(m["name"].alias("method"), m["line"].alias("line"), n(m).alias("n_primitive")))
    return with_marks(_cs(files)).select("file_name", F.inline(rows)).where(F.col("n_primitive") >= 3)


def layer_mix(files: DataFrame) -> DataFrame:
    """Classes named like user interface that own members named like, or using, business logic."""
    classes = _kind("class")

    def row(m: Column, i: Column) -> Column:
        own = F.try_element_at(F.filter(classes, lambda c: c["line"] <= m["line"]), F.lit(-1))
        return F.struct(own["name"].alias("class_name"), (m["kind"] == "method").alias("is_method"),
                        any_of([contains_ci(m["name"], w) | contains_ci(body_of(m, i), w) for w in BUSINESS_WORDS]).alias("business"))

    owned = F.filter(F.transform("marks", row), lambda r: r["is_method"] & r["business"])
    names = F.array_distinct(F.transform(owned, lambda r: r["class_name"]))
    df = with_marks(_cs(files)).select("file_name", F.explode(names).alias("class_name"))
    return df.where(any_of([contains_ci(F.col("class_name"), w) for w in UI_WORDS]))


def inheritance_depth(files: DataFrame, over: int = 4) -> DataFrame:
    """Depth of each class's base chain inside its file; an outside base adds one.

    The chain is walked by a fold over the file's own classes, so its length is
    bounded by their number and no join is needed.
    """
    classes = _kind("class")
    df = with_marks(_cs(files)).select("file_name", classes.alias("cls")).where(F.size("cls") > 0)

    def first_base(c: Column) -> Column:
        return F.trim(F.substring_index(c["bases"], ",", 1))

    def walk(c: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), first_base(c).alias("base"))

        def step(acc: Column, _: Column) -> Column:
            hit = F.get(F.filter("cls", lambda k: k["name"] == acc["base"]), F.lit(0))
            return F.when(acc["base"] == "", acc).otherwise(F.struct(
                (acc["depth"] + 1).alias("depth"), F.coalesce(F.trim(F.substring_index(hit["bases"], ",", 1)), F.lit("")).alias("base")))

        return F.aggregate("cls", start, step)["depth"]

    rows = F.transform("cls", lambda c: F.struct(c["name"].alias("class_name"), c["line"].alias("line"), walk(c).alias("depth")))
    return df.select("file_name", F.inline(rows)).where(F.col("depth") > over)


def line_patterns(files: DataFrame) -> DataFrame:
    """Per-line language patterns, tested on exploded lines of the file's language."""
    lines = explode_lines(files)
    t = F.col("text")

    def struct(kind: str, deprecated: bool) -> Column:
        return F.struct(F.lit(kind).alias("pattern_type"), F.lit(deprecated).alias("is_deprecated"))

    tests = [F.when((F.col("language") == lang) & t.rlike(jre(p, "")), struct(kind, dep)) for lang, kind, p, dep in R.LINE_PATTERNS]
    callbacks = n_of(t, R.CALLBACK_MARKS[0], "") + n_of(t, R.CALLBACK_MARKS[1], "")
    tests.append(F.when((F.col("language") == "javascript") & (callbacks >= R.CALLBACK_MIN), struct("CallbackHell", False)))
    go = t.rlike(jre(R.GO_CALL_END, "")) & ~any_of([t.contains(w) for w in R.GO_HANDLED]) & any_of([t.contains(w) for w in R.GO_ERROR_WORDS])
    tests.append(F.when((F.col("language") == "go") & go, struct("MissingErrorHandling", False)))
    return lines.select("file_name", "language", "line", F.trim(t).alias("snippet"), F.inline(F.array_compact(F.array(*tests))))


def semantic_quality(issues: DataFrame, patterns: DataFrame) -> DataFrame:
    """100 less 5 per severity point and 10 per deprecated pattern, kept in 0..100."""
    a = issues.select("file_name", (F.col("severity") * 5).alias("cost"))
    b = patterns.where("is_deprecated").select("file_name", F.lit(10).alias("cost"))
    return a.unionByName(b).groupBy("file_name").agg(F.sum("cost").alias("cost")).select(
        "file_name", F.least(F.greatest(100 - F.col("cost"), F.lit(0)), F.lit(100)).alias("quality"))
