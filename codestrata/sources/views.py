"""Views that shape the driver tables into the library's inputs.

Each view is a deterministic projection (no aggregate, no row limit), so its
work grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..data.samples import SAMPLES
from ..data.snippets import EXTENSIONS, snippet_grid
from ..functions.text import detect_language, text_array

MODULES = ["Controllers", "Services", "Models", "Repository", "Tests"]
AS_OF = "2024-01-01"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(text_array(values), (index + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table whose files make fewer scan tasks than there are slots (one small file is one task).

    Any other table is left alone: its text is never shuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source file: a code text followed by the document's prose."""
    return shape_files(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")))


def shape_files(d: DataFrame) -> DataFrame:
    """The projection alone: also serves a stream of documents."""
    src = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    module = _pick(MODULES, src % 5)
    ext = _pick(EXTENSIONS, F.col("doc_id") % 7)
    code = _pick(snippet_grid(), (F.col("doc_id") % 7) * 12 + F.col("doc_id") % 12)
    return d.select(
        F.concat(F.lit("app/"), module, F.lit("/Unit"), (F.col("doc_id") % 50).cast("string"), F.lit("_"),
                 F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_name"),
        module.alias("module"),
        (src % 4).cast("int").alias("project"),
        ext.alias("ext"),
        F.concat(code, F.lit("\n"), F.col("text")).alias("content"),
        F.col("n_chars").alias("size"),
        F.date_add(F.lit("2012-01-01").cast("date"), (F.col("doc_id") % 4000).cast("int")).alias("last_modified"),
    )


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document: a text with nested types and long heads, followed by the document's prose."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ext = _pick(EXTENSIONS, F.col("doc_id") % 7)
    code = _pick([SAMPLES[e] for e in EXTENSIONS], F.col("doc_id") % 7)
    name = F.concat(F.lit("app/Nested/U"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select(name.alias("file_name"), detect_language(name).alias("language"), F.concat(code, F.lit("\n"), F.col("text")).alias("content"))


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    return p.select(
        F.concat(path, F.lit("_"), F.col("page_id").cast("string"), F.lit(".js")).alias("file_name"),
        F.lit("javascript").alias("language"),
        F.col("html").alias("content"),
    )


def _category() -> Column:
    return (
        F.when(F.col("event_type") == "error", "SQL Injection")
        .when(F.col("event_type") == "signup", "Authentication")
        .when(F.col("event_type") == "purchase", "Performance")
        .when(F.col("event_type") == "click", "Architecture")
        .otherwise("Design")
    )


def _sev_step() -> Column:
    return F.when(F.col("value") < 25, 0).when(F.col("value") < 75, 1).when(F.col("value") < 150, 2).otherwise(3)


SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _line() -> Column:
    return F.floor(F.col("event_id") / 50) % 40 + 1


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # a category no known issue has, so that some findings are false positives
    category = F.when((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0), "Naming").otherwise(_category())
    location = F.concat(F.lit("Unit"), (F.col("event_id") % 50).cast("string"), F.lit(".cs:"), _line().cast("string"))
    return e.select(
        F.col("event_id").alias("finding_id"),
        (F.col("event_id") % 10 + 1).cast("int").alias("run_number"),
        _pick(["security", "performance", "architecture"], F.col("user_id") % 3).alias("agent"),
        category.alias("category"),
        _pick(SEVERITIES, _sev_step()).alias("severity"),
        location.alias("location"),
        F.concat(category, F.lit(" in "), location).alias("description"),
        F.array("event_type", "props").alias("evidence"),
    )


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of repeated runs: the same place and kind comes back in several runs."""
    f = findings(spark, sf_dir)
    return f.withColumn("run_number", (F.floor(F.col("finding_id") / 400) % 10 + 1).cast("int")).withColumn(
        "location", F.concat(F.lit("Unit"), (F.col("finding_id") % 400).cast("string"), F.lit(".cs:"),
                             (F.floor(F.col("finding_id") / 50) % 200 + 1).cast("string"))
    )


def gt_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known issues, one per event, shifted a little in category, severity and line."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    synonym = (
        F.when(F.col("event_type") == "error", "sqli").when(F.col("event_type") == "signup", "auth")
        .when(F.col("event_type") == "purchase", "perf").when(F.col("event_type") == "click", "arch")
        .otherwise("design")
    )
    step = F.when(F.col("event_id") % 3 == 0, F.greatest(_sev_step() - 1, F.lit(0))).otherwise(_sev_step())
    line = (_line() + F.col("event_id") % 9 - 4).cast("int")
    return e.select(
        F.concat(F.lit("GT"), F.col("event_id").cast("string")).alias("issue_id"),
        F.col("event_id").alias("issue_order"),
        F.when(n % 2 == 1, synonym).otherwise(_category()).alias("category"),
        _pick(SEVERITIES, step).alias("severity"),
        F.concat(F.lit("Unit"), (F.col("event_id") % 50).cast("string"), F.lit(".cs:"), _line().cast("string")).alias("location"),
        F.when(F.col("event_id") % 15 != 0, line).alias("line_number"),
        F.when(F.col("event_id") % 10 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(_pick(["security", "performance", "architecture"], F.col("event_id") % 3))).alias("expected_agents"),
        (F.col("event_id") % 20 != 0).alias("is_mandatory"),
        _pick(["easy", "medium", "hard"], F.col("event_id") % 3).alias("difficulty"),
    )


def gt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), _pick(EXTENSIONS, F.col("doc_id") % 7).alias("language"),
                    (F.col("n_chars") % 4).cast("int").alias("issue_count"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("analysis_id"),
        F.col("o_custkey").alias("project"),
        _pick(["SecurityAgent", "PerformanceAgent", "ArchitecturalAgent", "OtherAgent"], F.col("o_orderkey") % 4).alias("agent"),
        F.when(p == "1-URGENT", "CRITICAL").when(p == "2-HIGH", "HIGH").when(p == "3-MEDIUM", "MEDIUM")
        .when(p == "5-LOW", "LOW").otherwise("").alias("priority"),
        (F.col("o_orderkey") % 101).cast("int").alias("confidence"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_orderkey") % 17 == 0).alias("is_error"),
    )


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("analysis_id"),
        F.concat(F.lit("Rec "), (F.col("l_partkey") % 40).cast("string")).alias("title"),
        F.col("l_quantity").cast("decimal(12,2)").alias("hours"),
        F.when(F.col("l_linenumber") == 7, "").when(F.col("l_returnflag") == "A", "HIGH")
        .when(F.col("l_returnflag") == "R", "MEDIUM").otherwise("LOW").alias("priority"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", F.col("role").alias("from_agent"),
        _pick(["Analysis", "PeerReview", "Challenge", "Synthesis"], F.col("turn") % 4).alias("type"),
        "text",
        (F.lit("2024-01-01 00:00:00").cast("timestamp")
         + F.make_dt_interval(mins=(F.col("conv_id") * 60 + F.col("turn")).cast("int"))).alias("ts"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers in four shapes: plain JSON, fenced JSON, JSON inside text, prose."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = F.expr("substring(to_json(named_struct('t', text)), 7, length(to_json(named_struct('t', text))) - 8)")  # the whole text, escaped
    file = F.concat(F.lit("Unit"), (F.col("conv_id") % 50).cast("string"), F.lit(".cs"))
    body = F.concat(
        F.lit('{"confidenceScore": '), (F.col("conv_id") % 90 + 10).cast("string"),
        F.lit(', "businessImpact": "cost risk", "findings": ['),
        F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(
            F.lit('{"category": "SQL Injection", "description": "'), first, F.lit('", "severity": "HIGH", "location": "'),
            file, F.lit(':7"}'))),
        F.lit('], "recommendations": [{"title": "Fix '), (F.col("turn") % 5).cast("string"),
        F.lit('", "estimatedHours": '), (F.col("conv_id") % 40).cast("string"), F.lit(', "priority": "HIGH"}],'),
        F.lit(' "semanticIssues": [{"issueType": "TypeSafety", "category": "naming", "severity": '),
        (F.col("conv_id") % 5).cast("string"), F.lit(', "lineNumber": '), (F.col("turn") + 1).cast("string"), F.lit('}],'),
        F.lit(' "analyses": [{"fileName": "'), file, F.lit('", "assessment": "'), first, F.lit('"}]}'),
    )
    prose = F.concat(
        F.lit("Finding: critical SQL injection in "), file, F.lit(" line 12\nIssue: high memory risk in class Cart\n"),
        F.lit("1. Review authentication design\n- Improve database caching and refactor the pattern\nRecommendation: add tests.\n"),
        F.col("text"),
    )
    shape = F.col("conv_id") % 4
    raw = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(shape == 2, F.concat(F.lit("Result follows. "), F.substring_index(body, "]}", 1), F.lit(",]} thanks")))
        .otherwise(prose)
    )
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        _pick(["security", "performance", "architecture"], F.col("conv_id") % 3).alias("agent"),
        "conv_id", "turn", file.alias("expected_file"),
        raw.alias("raw"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    base = F.floor(F.col("p_partkey") / 8) * 8
    targets = F.array((base + (F.col("p_partkey") * 3 + 1) % 8),
                      F.when(F.col("p_partkey") % 5 == 0, base + (F.col("p_partkey") + 1) % 8))
    return (
        p.select(F.col("p_partkey").alias("s"), F.explode(targets).alias("d"))
        .where("d IS NOT NULL AND s <> d")
        .select(F.concat(F.lit("F"), F.col("s").cast("string")).alias("src"),
                F.concat(F.lit("F"), F.col("d").cast("string")).alias("dst"))
        .distinct()
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_requests(table(spark, sf_dir, "events"))


def shape_requests(e: DataFrame) -> DataFrame:
    """The projection alone: also serves a stream of events."""
    # time is compressed so that one minute holds several events
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    offset_ms = F.floor(micros / 600000)
    return e.select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") % 20).alias("client"),
        F.concat(F.lit("agent"), (F.col("user_id") % 10).cast("string")).alias("agent"),
        (F.lit(1704067200000) + offset_ms).cast("bigint").alias("ts_ms"),
        F.timestamp_millis(F.lit(1704067200000) + offset_ms).alias("ts"),
        F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string")).alias("fingerprint_key"),
        _pick(["gpt-4", "gpt-35-turbo"], F.col("event_id") % 2).alias("model"),
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 3).cast("bigint").alias("output_tokens"),
        F.col("event_type").alias("operation"),
        F.floor(F.col("value") * 100).cast("bigint").alias("duration_ms"),
        F.col("value"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
                    F.col("o_orderpriority").alias("analysis_type"),
                    F.floor(F.col("o_totalprice") % 101).cast("int").alias("overall_score"))


def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("session_id"),
                     F.concat(F.lit("File"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"),
                              F.lit(".cs")).alias("file_name"),
                     F.col("l_quantity").cast("int").alias("complexity"))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    parts = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double") * 1000, 0).cast("int"))
    return v.select(
        F.col("vec_id").alias("finding_id"), parts.alias("parts"),
        F.when(F.col("vec_id") % 7 == 0, F.lit(None).cast("int")).when(F.col("vec_id") % 3 == 0, F.lit(0))
        .otherwise((F.col("vec_id") % 140 - 20).cast("int")).alias("score"),
    )
