"""Roll-ups from files to modules, folders and projects, and the scores built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..data.advice import ADVICE, STEPS
from ..data import rules as R
from ..data.bands import BAND_SCHEMA, BANDS
from ..functions.ordered import position, running
from ..functions.text import any_of, chosen, file_stem, pct
from . import legacy as L
from .measures import file_complexity

# --- fixed values ------------------------------------------------------------
KNOWN_FOLDERS = [
    "Models", "Model", "Services", "Service", "Controllers", "Controller", "Views", "View", "Data", "DataAccess", "DAL",
    "Business", "BusinessLogic", "BLL", "Common", "Shared", "Utilities", "Utils", "Infrastructure", "Infra", "Domain",
    "Entities", "Entity", "Repositories", "Repository", "Repo", "Interfaces", "Contracts", "Helpers", "Extensions",
]
FOLDER_PURPOSE = [
    (["controller"], "API Controllers and Web Endpoints"), (["service"], "Business Logic Services"),
    (["model", "dto"], "Data Models and Transfer Objects"), (["repository", "data"], "Data Access Layer"),
    (["view"], "User Interface Views"), (["test"], "Unit and Integration Tests"),
    (["util", "helper"], "Utility Functions and Helpers"),
]
FOLDER_ROLE = [
    (["controller"], "Presentation Layer"), (["service", "business"], "Business Logic Layer"),
    (["repository", "data"], "Data Access Layer"), (["model"], "Domain Layer"), (["common", "shared"], "Cross-Cutting Concerns"),
]
LAYERS = [
    ("Presentation Layer", ["controller", "api"]), ("Business Logic Layer", ["service", "business"]),
    ("Data Access Layer", ["repository", "data"]), ("Domain Layer", ["model", "domain"]),
]
DESIGN_PATTERNS = [
    ("Repository Pattern", ["repository"]), ("Service Layer Pattern", ["service", "manager"]), ("Factory Pattern", ["factory"]),
    ("Builder Pattern", ["builder"]), ("Adapter Pattern", ["adapter", "wrapper"]),
]
COMPLIANCE = {"HIGH": 15000, "MEDIUM": 8000, "LOW": 3000}
# parameters the reference reads from a configuration file; these are our defaults
SCORE_STEPS = {"very_low": 10, "low": 30, "medium": 50, "high": 60, "very_high": 70, "critical": 40}
RISK_STEPS = (30, 60)
PROJECT_SIZES = [("Small Project", 5, 10), ("Medium Project", 15, 50), ("Large Project", 30, 150)]
HOURLY_RATE = 125


def risk_level(score: Column, low: int = 30, high: int = 60) -> Column:
    return F.when(score < low, "LOW").when(score < high, "MEDIUM").otherwise("HIGH")


def _sums() -> list[Column]:
    return [F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ["classes", "methods", "properties", "imports", "loc"]]]


def project_totals(counts: DataFrame) -> DataFrame:
    """Sums per (project, module), per project and overall in one pass."""
    out = counts.rollup("project", "module").agg(*_sums())
    return out.withColumn("project", F.coalesce(F.col("project").cast("string"), F.lit("all"))).withColumn(
        "module", F.coalesce("module", F.lit("all")))


def per_project(counts: DataFrame) -> DataFrame:
    """Totals, mean file score and overall score of each project."""
    score = file_complexity(F.col("classes"), F.col("methods"), F.col("imports"))
    t = counts.withColumn("score", score).groupBy("project").agg(
        *_sums(), F.avg("score").alias("avg_score"), F.sum("score").alias("sum_score"))
    ratio = F.when(F.col("classes") > 0, F.col("methods") / F.col("classes")).otherwise(0.0)
    overall = F.col("avg_score") + F.least(F.col("files") * 1.5, F.lit(20.0)) + ratio * 2
    t = t.withColumn("overall", F.least(F.lit(100), F.greatest(F.lit(0.0), overall).cast("int")))
    return t.withColumn("risk", risk_level(F.col("overall")))


def risk_distribution(scored: DataFrame, medium: int = 40, high: int = 70) -> DataFrame:
    s = F.col("score")
    out = scored.groupBy("project").agg(
        F.count("*").alias("files"), F.count_if(s < medium).alias("low"),
        F.count_if((s >= medium) & (s < high)).alias("medium"), F.count_if(s >= high).alias("high"))
    return out.select("*", *[F.round(pct(F.col(c), F.col("files")), 4).alias(f"{c}_pct") for c in ["low", "medium", "high"]])


def quality_split(scored: DataFrame) -> DataFrame:
    done = F.col("status") == "Completed"
    return scored.groupBy("project").agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"),
                                         F.round(F.coalesce(F.avg(F.when(done, F.col("score"))), F.lit(0.0)), 4).alias("avg_score"))


def top_files(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("score"), "file_name").limit(k)


def preprocess_summary(meta: DataFrame) -> DataFrame:
    t = meta.groupBy("project").agg(
        F.count("*").alias("files"), F.sum("cyclomatic").alias("complexity"), F.sum("security_hits").alias("security"),
        F.sum("performance_hits").alias("performance"), F.sum("architecture_hits").alias("architecture"))
    return t.withColumn("risk", F.when(F.col("security") > 0, "High").when(F.col("performance") + F.col("architecture") > 3, "Medium").otherwise("Low"))


# --- legacy issues --------------------------------------------------------------
def legacy_issues(files: DataFrame) -> DataFrame:
    """All legacy issues as rows (file, type, severity, line): one pass for located patterns."""
    located = ([(pid, p) for pid, p in L.numbered("ObsoleteApi#", R.OBSOLETE_API)] + [("MagicNumber#", R.MAGIC_NUMBER), ("EmptyCatchBlock#", R.EMPTY_CATCH)])
    m = L.match_lines(files, located).select("file_name", F.substring_index("pattern_id", "#", 1).alias("pattern_type"), "line")
    m = m.withColumn("severity", F.when(F.col("pattern_type") == "MagicNumber", "Medium").otherwise("High"))
    g = L.global_state(files).select("file_name", F.lit("GlobalState").alias("pattern_type"), "line", "severity")
    god = L.god_objects(files).select("file_name", F.lit("GodObject").alias("pattern_type"), "line", F.lit("High").alias("severity"))
    dead = L.dead_methods(files).select("file_name", F.lit("DeadCode").alias("pattern_type"), "line", F.lit("Low").alias("severity"))
    c = L.coupling(files).select("file_name", F.lit("CyclicDependency").alias("pattern_type"), F.lit(None).cast("int").alias("line"),
                                 F.when(F.col("scope") == "file", "High").otherwise("Medium").alias("severity"))
    out = m.unionByName(g).unionByName(god).unionByName(dead).unionByName(c)
    return out.select("file_name", "pattern_type", "severity", F.coalesce("line", F.lit(0)).alias("line"))


def legacy_rollup(issues: DataFrame, top: int = 5) -> DataFrame:
    """Per file: totals by severity, indicator flags and the commonest types."""
    by_type = issues.groupBy("file_name", "pattern_type").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ["Critical", "High", "Medium", "Low"]])
    # at most one entry per issue type, so the list is bounded by the number of types
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("pattern_type").alias("t")))), 1, top)
    return by_type.groupBy("file_name").agg(
        F.sum("n").alias("issues"), *[F.sum(s).alias(s) for s in ["critical", "high", "medium", "low"]],
        F.bool_or(F.col("pattern_type") == "GlobalState").alias("has_global_state"),
        F.bool_or(F.col("pattern_type") == "ObsoleteApi").alias("uses_obsolete_apis"),
        F.array_join(F.transform(ranked, lambda x: F.concat(x["t"], F.lit(" ("), (-x["o"]).cast("string"), F.lit(")"))), ", ").alias("top_types"))


def legacy_corpus(rollup: DataFrame, ages: DataFrame) -> DataFrame:
    """Files per indicator over the corpus."""
    a = ages.agg(F.count_if("is_very_old").alias("n_old"), F.count_if("is_ancient").alias("n_ancient"), F.count("*").alias("n_files"))
    r = rollup.agg(F.count_if("has_global_state").alias("n_global"), F.count_if("uses_obsolete_apis").alias("n_obsolete"),
                   F.coalesce(F.sum("issues"), F.lit(0)).alias("n_issues"))
    rows = [("very old files", a, "n_old"), ("ancient framework files", a, "n_ancient"), ("files", a, "n_files"),
            ("global state files", r, "n_global"), ("obsolete api files", r, "n_obsolete"), ("issues", r, "n_issues")]
    pairs = {id(a): [], id(r): []}
    for label, df, col in rows:
        pairs[id(df)].append(F.struct(F.lit(label).alias("indicator"), F.col(col).alias("n")))
    return a.select(F.inline(F.array(*pairs[id(a)]))).unionByName(r.select(F.inline(F.array(*pairs[id(r)]))))


def severity_rank(sev: Column) -> Column:
    s = F.upper(sev)
    return F.when(s == "CRITICAL", 4).when(s == "HIGH", 3).when(s == "MEDIUM", 2).when(s == "LOW", 1).otherwise(0)


def legacy_browse(issues: DataFrame, severities: list[str]) -> DataFrame:
    return issues.where(F.col("severity").isin(severities)).withColumn("rank", severity_rank(F.col("severity")))


# --- modules and batches ----------------------------------------------------------
def module_of(file_name: Column, container: Column) -> Column:
    path = F.replace(file_name, F.lit("\\"), F.lit("/"))
    low = F.lower(path)
    known = None
    for k in KNOWN_FOLDERS:
        c = low.contains(f"/{k.lower()}/")
        known = F.when(c, k) if known is None else known.when(c, k)
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    last = F.substring_index(container, ".", -1)
    return F.coalesce(F.when(last != "", last), known, F.when(parent != "", parent), F.lit("Other"))


def pack_batches(files: DataFrame, size: int = 10) -> DataFrame:
    """Largest modules first, batches of ``size`` in that order."""
    sizes = files.groupBy("module").agg(F.count("*").alias("module_size"))
    d = files.select("file_name", "module").join(sizes, "module")
    ranked = position(d, [F.desc("module_size"), F.asc("module"), F.asc("file_name")])
    return ranked.select("file_name", "module", "module_size", "position", F.floor(F.col("position") / size).alias("batch"))


def pack_report(packed: DataFrame) -> DataFrame:
    """Calls saved by batching."""
    t = packed.agg(F.count("*").alias("files"), F.countDistinct("batch").alias("batches"))
    return t.withColumn("reduction_pct", F.when(F.col("files") > 0, F.bround((1.0 - F.col("batches") / F.col("files")) * 100.0, 1)).otherwise(0.0))


def batch_payload(packed: DataFrame, files: DataFrame, base_len: int = 1200, min_len: int = 400) -> DataFrame:
    """Text of each batch: capped previews, shorter in larger batches.

    Only the preview leaves the scan; a batch holds at most ten of them.
    """
    head = files.select("file_name", F.substring("content", 1, base_len).alias("head"), F.length("content").alias("len"),
                        "classes", "methods", "properties")
    n = F.col("n")
    limit = F.when(n > 3, F.greatest(F.lit(min_len), F.floor(base_len / F.floor(n / 2)))).otherwise(base_len).cast("int")
    sizes = packed.groupBy("batch").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    d = packed.select("file_name", "batch", "position").join(head, "file_name").join(sizes, "batch")
    preview = F.when(F.col("len") > limit, F.concat(F.substring(F.col("head"), F.lit(1), limit), F.lit("..."))).otherwise(F.col("head"))
    section = F.concat(F.lit("FILE "), (F.col("position") - F.col("first") + 1).cast("string"), F.lit(": "), F.col("file_name"),
                       F.lit("\nMetrics: "), F.col("classes").cast("string"), F.lit(" classes, "), F.col("methods").cast("string"),
                       F.lit(" methods, "), F.col("properties").cast("string"), F.lit(" properties\nCode:\n"), preview)
    rows = d.select("batch", "position", section.alias("section"))
    return rows.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "section"))),
                                                              lambda x: x["section"]), "\n---\n").alias("payload"), F.count("*").alias("n_files"))


def batch_eta(log: DataFrame) -> DataFrame:
    """Mean batch time so far times batches left, per analysis, in time order."""
    totals = log.groupBy("client").agg(F.count("*").alias("batches"))
    r = running(log, ["client"], ["ts_ms", "request_id"], {"done": F.lit(1), "spent_ms": F.col("duration_ms")})
    r = r.join(totals, "client")
    # at batch k the mean is over the k - 1 finished ones
    finished = F.col("done") - 1
    eta = F.when(finished > 0, (F.col("spent_ms") - F.col("duration_ms")) / finished * (F.col("batches") - F.col("done")))
    return r.select("request_id", "client", F.col("done").alias("batch_number"), "batches", F.round(eta, 4).alias("eta_ms"))


def throughput(log: DataFrame) -> DataFrame:
    t = log.groupBy("operation").agg(F.count("*").alias("files"), F.sum("duration_ms").alias("busy_ms"),
                                     (F.max(F.col("ts_ms") + F.col("duration_ms")) - F.min("ts_ms")).alias("elapsed_ms"))
    return t.select("operation", "files", F.round(F.col("busy_ms") / F.col("files"), 4).alias("ms_per_file"),
                    F.round(F.when((F.col("elapsed_ms") > 0) & (F.col("busy_ms") > 0), F.col("busy_ms") / F.col("elapsed_ms")).otherwise(1.0), 4).alias("speed_up"),
                    F.round(F.when(F.col("elapsed_ms") > 0, F.col("files") * 1000.0 / F.col("elapsed_ms")).otherwise(0.0), 4).alias("files_per_sec"))


# --- folders and architecture ------------------------------------------------------
def _by_word(text: Column, table: list[tuple[list[str], str]], default: str) -> Column:
    out = None
    for words, label in table:
        c = any_of([F.lower(text).contains(w) for w in words])
        out = F.when(c, label) if out is None else out.when(c, label)
    return out.otherwise(default)


def folder_analysis(files: DataFrame, key_classes: int = 5) -> DataFrame:
    """Per project and folder: C# files, purpose, role, first classes, score."""
    cs = files.where(F.lower("file_name").endswith(".cs")).withColumn("folder", F.regexp_extract("file_name", r"^(.*)/[^/]*$", 1))
    agg = cs.groupBy("project", "folder").agg(F.count("*").alias("n_files"))
    # row_number <= k is cut per map task before the shuffle, so a large folder sends k rows per task
    w = W.partitionBy("project", "folder").orderBy("file_name")
    first = cs.select("project", "folder", "file_name", F.row_number().over(w).alias("rn")).where(F.col("rn") <= key_classes)
    names = first.groupBy("project", "folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", file_stem(F.col("file_name")).alias("s")))),
                                                                             lambda x: x["s"]), ", ").alias("key_classes"))
    score = F.least(F.lit(100), F.col("n_files") * 5 + F.when(F.col("n_files") > 10, 20).otherwise(0))
    return agg.join(names, ["project", "folder"]).select(
        "project", "folder", "n_files", _by_word(F.col("folder"), FOLDER_PURPOSE, "Application Logic Components").alias("purpose"),
        _by_word(F.col("folder"), FOLDER_ROLE, "Application Layer").alias("role"), "key_classes", score.alias("score"))


def project_type(files: DataFrame) -> DataFrame:
    n = F.lower("file_name")
    t = files.groupBy("project").agg(F.bool_or(n.endswith(".sln")).alias("sln"), F.bool_or(n.endswith(".csproj")).alias("csproj"),
                                     F.count_if(n.endswith(".cs")).alias("cs"))
    return t.select("project", F.when(F.col("sln"), "Visual Studio Solution").when(F.col("csproj"), ".NET Project")
                    .when(F.col("cs") > 10, "Large Source Code Project").otherwise("Source Code Files").alias("project_type"))


def architecture_assess(folders: DataFrame, files: DataFrame) -> DataFrame:
    low = F.lower("folder")

    def seen(words: list[str], text: Column = low) -> Column:
        return F.bool_or(any_of([text.contains(w) for w in words]))

    f = folders.groupBy("project").agg(
        seen(["controller"]).alias("c"), seen(["service"]).alias("s"), seen(["repository"]).alias("r"), seen(["model"]).alias("m"),
        *[seen(words).alias(f"l{i}") for i, (_, words) in enumerate(LAYERS)],
        F.countDistinct("role").alias("roles"), F.countDistinct(F.when(low.contains("test"), F.col("folder"))).alias("test_folders"))
    name = F.lower("file_name")
    p = files.groupBy("project").agg(*[seen(words, name).alias(f"p{i}") for i, (_, words) in enumerate(DESIGN_PATTERNS)])
    d = f.join(p, "project", "left")
    pattern = (F.when(F.col("c") & F.col("s") & F.col("r"), "Layered Architecture (MVC/Clean Architecture)")
               .when(F.col("c") & F.col("s"), "Service-Oriented Architecture").when(F.col("m") & F.col("s"), "Domain-Driven Design")
               .otherwise("Monolithic Architecture"))
    separation = (F.when(F.col("roles") >= 4, "Excellent separation of concerns with clear architectural layers")
                  .when(F.col("roles") >= 3, "Good separation with distinct business and data layers")
                  .when(F.col("roles") >= 2, "Basic separation between presentation and logic")
                  .otherwise("Poor separation - mixed concerns across components"))
    layers = chosen([(label, F.col(f"l{i}")) for i, (label, _) in enumerate(LAYERS)])
    patterns = chosen([(label, F.col(f"p{i}")) for i, (label, _) in enumerate(DESIGN_PATTERNS)])
    tests = (F.when(F.col("test_folders") >= 2, "Good test coverage with multiple test projects")
             .when(F.col("test_folders") >= 1, "Basic test coverage detected").otherwise("No test projects detected - testing strategy needed"))
    d = d.select("project", pattern.alias("pattern"), F.when(F.size(layers) > 0, F.array_join(layers, ", ")).otherwise("Single Layer Architecture").alias("layers"),
                 separation.alias("separation"), F.when(F.size(patterns) > 0, F.array_join(patterns, ", ")).otherwise("No clear design patterns detected").alias("design_patterns"),
                 tests.alias("test_coverage"))
    debt = (F.when(F.col("separation").contains("Poor"), 30).when(F.col("separation").contains("Basic"), 15).otherwise(0)
            + F.when(F.col("pattern").contains("Monolithic"), 20).otherwise(0)
            + F.when(F.col("design_patterns").contains("No clear"), 25).otherwise(0)
            + F.when(F.col("test_coverage").contains("No test"), 25).otherwise(0))
    return d.withColumn("debt", F.least(F.lit(100), debt))


def business_impact(projects: DataFrame, arch: DataFrame, folders: DataFrame) -> DataFrame:
    """Estimated value, risk, overhead, critical areas, approach and priority per project."""
    critical = folders.where((F.col("score") > SCORE_STEPS["high"]) | F.col("role").contains("Business"))
    w = W.partitionBy("project").orderBy("folder")
    critical = critical.select("project", "folder", F.row_number().over(w).alias("rn")).where("rn <= 5").groupBy("project").agg(
        F.array_join(F.array_sort(F.collect_list("folder")), ", ").alias("critical_areas"))
    d = projects.join(arch.select("project", "debt"), "project").join(critical, "project", "left")
    avg = F.floor(F.col("sum_score") / F.col("files")).cast("int")
    d = d.withColumn("avg", avg)
    value = F.least(F.lit(1000000).cast("decimal(20,4)"), F.col("loc").cast("decimal(12,0)") * F.lit("0.10").cast("decimal(4,2)")
                    * (F.col("avg").cast("decimal(6,0)") / F.lit(100).cast("decimal(6,0)") + F.lit("0.5").cast("decimal(4,2)")))
    d = d.withColumn("value", value.cast("double"))
    d = d.withColumn("impact_risk", risk_level(F.floor((F.col("avg") + F.col("debt")) / 2), *RISK_STEPS))
    overhead = (F.when(F.col("debt") < SCORE_STEPS["low"], "Low maintenance overhead with good architectural practices")
                .when(F.col("debt") < SCORE_STEPS["high"], "Moderate maintenance overhead requiring structured approach")
                .otherwise("High maintenance overhead with significant refactoring needs"))
    approach = (F.when((F.col("impact_risk") == "LOW") & (F.col("files") < SCORE_STEPS["very_low"]), "Standard agile development with code review practices")
                .when(F.col("impact_risk") == "LOW", "Structured development with architectural guidance")
                .when(F.col("impact_risk") == "MEDIUM", "Phased modernization with risk mitigation strategies")
                .otherwise("Comprehensive modernization program with dedicated architecture team"))
    priority = (F.when((F.col("impact_risk") == "HIGH") & (F.col("value") > 100000), "CRITICAL - Immediate executive attention required")
                .when(F.col("impact_risk") == "HIGH", "HIGH - Significant business risk requiring prompt action")
                .when((F.col("impact_risk") == "MEDIUM") & (F.col("value") > 50000), "MEDIUM - Strategic investment opportunity")
                .otherwise("LOW - Include in regular development planning cycle"))
    return d.select("project", "debt", F.round("value", 4).alias("value"), "impact_risk", overhead.alias("overhead"),
                    F.coalesce("critical_areas", F.lit("")).alias("critical_areas"), approach.alias("approach"), priority.alias("priority"))


def business_metrics(projects: DataFrame) -> DataFrame:
    dec = "decimal(20,4)"
    hours = F.col("methods").cast(dec) * F.lit("0.5").cast(dec) * (F.col("overall").cast(dec) / F.lit(100).cast("decimal(6,0)") + F.lit("0.5").cast(dec))
    avoidance = F.lit(1000)
    for level, cost in COMPLIANCE.items():
        avoidance = F.when(F.col("risk") == level, cost).otherwise(avoidance)
    size = None
    for label, max_files, max_classes in PROJECT_SIZES:
        c = (F.col("files") < max_files) & (F.col("classes") < max_classes)
        size = F.when(c, label) if size is None else size.when(c, label)
    o = F.col("overall")
    timeline = F.when(o < 30, "2-4 weeks").when(o < 50, "4-8 weeks").when(o < SCORE_STEPS["high"], "8-12 weeks").otherwise("12+ weeks")
    approach = (F.when(o < 30, "Agile development with standard practices").when(o < 50, "Structured approach with experienced team")
                .when(o < SCORE_STEPS["very_high"], "Phased migration with risk mitigation").otherwise("Enterprise methodology with dedicated team"))
    mitigation = (F.when(F.col("risk") == "HIGH", "Dedicated migration team with senior architect oversight required")
                  .when(F.col("risk") == "MEDIUM", "Experienced development team with structured approach recommended")
                  .otherwise("Standard development practices with code review sufficient"))
    d = projects.select("project", "risk", hours.cast("double").alias("hours_saved"), avoidance.alias("compliance_avoidance"),
                        size.otherwise("Enterprise Project").alias("project_size"), timeline.alias("timeline"), approach.alias("approach"), mitigation.alias("mitigation"))
    d = d.withColumn("savings", F.round(F.col("hours_saved") * HOURLY_RATE, 4))
    return d.withColumn("roi", F.round(F.col("savings") + F.col("compliance_avoidance"), 4)).withColumn("hours_saved", F.round("hours_saved", 4))


def manual_hours(projects: DataFrame, rate: int = HOURLY_RATE) -> DataFrame:
    h = (F.col("classes") * 2 + F.col("methods") * 0.25 + F.col("imports") * 0.5).cast("bigint")
    return projects.select("project", h.alias("hours"), (h * rate).alias("cost"))


def bands_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or BANDS, BAND_SCHEMA)


def band_lookup(measures: DataFrame, bands: DataFrame) -> DataFrame:
    """Label of each (measure, value) row: hash join on the measure, band bounds as residual."""
    v = F.col("value")
    cond = (F.col("lo").isNull() | (v >= F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi")))
    return measures.join(bands, "measure").where(cond).drop("lo", "hi")


def project_measures(projects: DataFrame) -> DataFrame:
    """The measures the band table speaks about, as (project, measure, value) rows."""
    report = F.least(F.greatest(F.floor((F.col("classes") * 3 + F.col("methods") + F.col("imports") * 2) / 2), F.lit(0)), F.lit(100))
    by = {
        "overall": ["risk level", "risk statistics", "complexity label", "status text", "maintenance level", "migration timeline",
                    "resource requirements", "financial impact", "executive timeline"],
        "report": ["cost estimate", "roi timeline", "complexity risk", "resource risk", "timeline risk"],
        "files": ["file count"], "classes": ["class count", "scale risk", "modernization roi"],
        "methods": ["method count", "business impact", "operational risk"], "imports": ["dependency risk"],
    }
    values = {k: F.col(k) for k in ["overall", "files", "classes", "methods", "imports"]} | {"report": report}
    items = [(m, values[k]) for k, ms in by.items() for m in ms]
    items.append(("technical debt", F.col("imports") + F.floor(F.col("methods") / F.greatest(F.col("classes"), F.lit(1)))))
    items.append(("migration complexity", F.col("classes") * F.col("methods")))
    items.append(("strategic priority", F.col("classes") * 2 + F.col("methods")))
    return projects.select("project", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in items])))


def recommend_project(projects: DataFrame, kind: str, cap: int = 6) -> DataFrame:
    o = F.col("overall")
    high, mid = o > SCORE_STEPS["very_high"], (o > SCORE_STEPS["critical"]) & (o <= SCORE_STEPS["very_high"])
    low = o <= SCORE_STEPS["critical"]
    ratio = F.when(F.col("classes") > 0, F.col("methods") / F.col("classes")).otherwise(0.0)
    large = F.col("files") > 25
    holds = {"high": high, "mid": mid, "low": low, "large": large, "ratio": ratio > 8, kind: F.lit(True)}
    advice = [(text, holds[when]) for when, text in ADVICE if when in holds]
    return projects.select("project", F.posexplode(F.slice(chosen(advice), 1, cap)).alias("rank", "advice"))


def next_steps(impact: DataFrame, arch: DataFrame, cap: int = 6) -> DataFrame:
    r = F.col("impact_risk")
    high, mid, low = r == "HIGH", r == "MEDIUM", ~r.isin("HIGH", "MEDIUM")
    debt, untested = F.col("debt") > SCORE_STEPS["high"], F.col("test_coverage").contains("No test")
    holds = {"HIGH": high, "MEDIUM": mid, "LOW": low, "debt": debt, "tests": untested}
    steps = [(text, holds[when]) for when, text in STEPS]
    d = impact.select("project", "impact_risk").join(arch.select("project", "debt", "test_coverage"), "project")
    return d.select("project", F.posexplode(F.slice(chosen(steps), 1, cap)).alias("rank", "step"))


# --- token estimates ------------------------------------------------------------------
def token_estimate(meta: DataFrame) -> DataFrame:
    """``meta``: summary text, counts and code length per file."""
    summary = F.ceil(F.length("summary") / 4.0)
    extra = (F.col("methods") * 15 + F.col("classes") * 7 + F.col("properties") * 4 + 10 + F.col("hits") * 5
             + F.col("imports") * 2 + F.when(F.col("container") != "", 3).otherwise(0))
    full = F.ceil(F.col("code_len") / 3.5)
    d = meta.select("file_name", (summary + extra).alias("summary_tokens"), full.alias("code_tokens"))
    return d.withColumn("reduction_pct", F.when(F.col("code_tokens") > 0, F.bround(
        (F.col("code_tokens") - F.col("summary_tokens")) / F.col("code_tokens") * 100.0, 2)).otherwise(0.0))


def token_budget(files: DataFrame, cost_per_token: str = "0.00003") -> DataFrame:
    base = F.floor(F.col("size") / 4)
    tokens = base + F.floor(base * 0.1)
    per = files.select("project", base.alias("base"), tokens.alias("tokens")).groupBy("project").agg(
        F.count("*").alias("files"), F.sum("tokens").alias("tokens"))
    return per.select("project", "files", "tokens", (F.lit(600) + F.col("files") * 80).alias("prompt_overhead"),
                      F.round((F.col("tokens") * F.lit(cost_per_token).cast("decimal(10,6)")).cast("double"), 4).alias("cost"))


def gt_dataset_stats(gt_files: DataFrame, gt_issues: DataFrame) -> DataFrame:
    """Issue counts by severity, category, difficulty (one pass), and by language from file counts."""
    g = gt_issues.groupingSets([["severity"], ["category"], ["difficulty"], []], "severity", "category", "difficulty").agg(
        F.count("*").alias("n"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "category").when(F.col("gid") == 6, "difficulty").otherwise("total issues")
    label = F.coalesce("severity", "category", "difficulty", F.lit(""))
    lang = gt_files.groupBy("language").agg(F.sum("issue_count").alias("n"))
    total = gt_files.agg(F.count("*").alias("n"))
    return (g.select(dim.alias("dimension"), label.alias("label"), "n")
            .unionByName(lang.select(F.lit("language").alias("dimension"), F.col("language").alias("label"), "n"))
            .unionByName(total.select(F.lit("total files").alias("dimension"), F.lit("").alias("label"), "n")))
