"""Match findings to known issues and measure precision and recall.

A finding's score against an issue depends only on small profiles: categories that match,
the severity, and a line or a location. Issues are therefore aggregated by profile (count and
first issue in order), and findings look their profiles up. No finding-issue pair is ever
written, so a category or a line that holds a third of all rows stays one profile row, while
counts and best matches are those of the full pair table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.substr import containing_pairs
from ..functions.text import jre, pct
from ..session import cut_lineage

# --- fixed values --------------------------------------------------------------
SEVERITY_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SYNONYMS = {
    "authentication": ["auth", "authn"],
    "authorization": ["authz", "access control"],
    "sql injection": ["sqli", "sql"],
    "cross site scripting": ["xss", "scripting"],
    "performance": ["perf", "optimization"],
    "architecture": ["arch", "design"],
}
LINE_FORMS = [r":(\d+)", r"line\s+(\d+)", r"#(\d+)"]


@dataclass(frozen=True)
class MatchConfig:
    category_weight: float = 0.5
    severity_weight: float = 0.3
    location_weight: float = 0.2
    min_confidence: float = 70.0
    severity_steps: int = 1
    line_steps: int = 5
    partial_counts: bool = True

    def score(self, severity: bool, location: bool) -> float:
        return (self.category_weight + (self.severity_weight if severity else 0) + (self.location_weight if location else 0)) * 100

    def check(self) -> None:
        if (self.severity_weight + self.location_weight) * 100 >= self.min_confidence:
            raise ValueError("the minimum must be out of reach without a category match")
        if self.severity_weight == self.location_weight:
            raise ValueError("severity and location weights must differ")


def normal_category(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "_-", "  ")


def line_of(location: Column) -> Column:
    hits = [F.regexp_extract(location, jre(p), 1) for p in LINE_FORMS]
    return F.coalesce(*[F.when(h != "", h.try_cast("int")) for h in hits])


def _synonym_group(c: Column) -> Column:
    out = None
    for key, words in SYNONYMS.items():
        cond = c.isin(key, *words)
        out = F.when(cond, key) if out is None else out.when(cond, key)
    return out


def category_pairs(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Distinct category texts that match: equal, one inside the other, or synonyms."""
    # the distinct texts are small and read several times
    a = cut_lineage(findings.select("fcat").distinct())
    b = cut_lineage(issues.select("icat").distinct())
    down = containing_pairs(a, "fcat", b, "icat").select("fcat", "icat")
    up = containing_pairs(b, "icat", a, "fcat").select("fcat", "icat")
    by_group = a.withColumn("g", _synonym_group(F.col("fcat"))).where("g IS NOT NULL").join(
        b.withColumn("g", _synonym_group(F.col("icat"))).where("g IS NOT NULL"), "g").select("fcat", "icat")
    # the empty text is inside every text
    blank = b.where(a.where("fcat = ''").exists()).select(F.lit("").alias("fcat"), "icat").union(
        a.where(b.where("icat = ''").exists()).select("fcat", F.lit("").alias("icat")))
    return down.union(up).union(by_group).union(blank).distinct()


def _prepared(findings: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    level = {s: i for i, s in enumerate(SEVERITY_LEVELS)}

    def step(c: Column) -> Column:
        out = F.lit(None).cast("int")
        for s, i in level.items():
            out = F.when(F.upper(c) == s, i).otherwise(out)
        return out

    f = findings.select("finding_id", "agent", F.col("category").alias("f_category"), F.upper("severity").alias("f_severity"),
                        normal_category(F.col("category")).alias("fcat"), step(F.col("severity")).alias("fsev"),
                        line_of(F.col("location")).alias("fline"), F.lower("location").alias("floc"))
    i = issues.select(
        normal_category(F.col("category")).alias("icat"), step(F.col("severity")).alias("isev"), F.col("line_number").alias("iline"),
        F.lower("location").alias("iloc"),
        F.struct(F.col("issue_order"), F.col("issue_id"), F.col("category").alias("i_category"), F.col("severity").alias("i_severity"),
                 F.col("is_mandatory"), F.col("expected_agents")).alias("issue"))
    return f, i


def _profile() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("first").alias("first")]


def _as_array(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per key with its (severity, count, first issue) entries: as many as there are severities."""
    return df.groupBy(*keys).agg(F.collect_list(F.struct("isev", "n", "first")).alias(name))


def _lookups(f: DataFrame, i: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    # these are read by every lookup below, so they are computed once
    pairs = cut_lineage(category_pairs(f, i))
    base = cut_lineage(i.groupBy("icat", "isev", "iline", "iloc").agg(F.count("*").alias("n"), F.min("issue").alias("first")))
    by_cat = base.groupBy("icat", "isev").agg(*_profile()).join(pairs, "icat").groupBy("fcat", "isev").agg(*_profile())
    near = F.explode(F.sequence(F.col("iline") - cfg.line_steps, F.col("iline") + cfg.line_steps)).alias("fline")
    by_line = (base.where("iline IS NOT NULL").groupBy("icat", "isev", "iline").agg(*_profile())
               .select("icat", "isev", "n", "first", near).groupBy("icat", "isev", "fline").agg(*_profile())
               .join(pairs, "icat").groupBy("fcat", "isev", "fline").agg(*_profile()))
    # places compare as text where either side has no line
    texts = cut_lineage(f.select("floc", "fcat", F.col("fline").isNotNull().alias("has_line")).where("floc <> ''").distinct())
    places = base.where("iloc <> ''").groupBy("icat", "isev", "iloc", F.col("iline").isNotNull().alias("i_has_line")).agg(*_profile())
    a, b = texts.select("floc").distinct(), places.select("iloc", "i_has_line")
    need_all = texts.where("NOT has_line").select("floc")
    b = b.where(~F.col("i_has_line") | need_all.exists()).select("iloc").distinct()
    near_text = containing_pairs(a, "floc", b, "iloc").select("floc", "iloc").union(
        containing_pairs(b, "iloc", a, "floc").select("floc", "iloc")).distinct()
    by_place = (near_text.join(places, "iloc").join(pairs, "icat").join(texts, ["floc", "fcat"])
                .where("NOT has_line OR NOT i_has_line").groupBy("fcat", "isev", "floc", "has_line").agg(*_profile()))
    return (_as_array(by_cat, ["fcat"], "cat"), _as_array(by_line, ["fcat", "fline"], "at_line"),
            _as_array(by_place, ["fcat", "floc", "has_line"], "at_place"))


def _scored(findings: DataFrame, issues: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Findings with the counts and first issues of every kind of match."""
    cfg.check()
    f, i = _prepared(findings, issues)
    cat, line, place = _lookups(f, i, cfg)
    d = f.withColumn("has_line", F.col("fline").isNotNull())
    d = d.join(cat, "fcat", "left").join(line, ["fcat", "fline"], "left").join(place, ["fcat", "floc", "has_line"], "left")
    empty = "cast(array() as array<struct<isev:int,n:bigint,first:struct<issue_order:bigint,issue_id:string,i_category:string,i_severity:string,is_mandatory:boolean,expected_agents:array<string>>>>)"
    none = F.expr(empty)
    located = F.concat(F.coalesce("at_line", none), F.coalesce("at_place", none))
    d = d.withColumn("cat", F.coalesce("cat", none)).withColumn("loc", located)

    def fits(e: Column) -> Column:
        return F.coalesce(F.abs(e["isev"] - F.col("fsev")) <= cfg.severity_steps, F.lit(False))

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, e: a + e["n"])

    def first(arr: Column) -> Column:
        return F.array_min(F.transform(arr, lambda e: e["first"]))

    cs, cl = F.filter("cat", fits), F.filter("loc", fits)
    ln = F.filter("loc", lambda e: ~fits(e))
    return d.select(
        "finding_id", "agent", "f_category", "f_severity",
        total(cl).alias("n_full"), first(cl).alias("first_full"),
        (total(cs) - total(cl)).alias("n_severity"), first(cs).alias("first_severity"),
        total(ln).alias("n_location"), first(ln).alias("first_location"),
        (total(F.col("cat")) - total(cs) - total(ln)).alias("n_category"), first(F.col("cat")).alias("first_category"))


def _kinds(cfg: MatchConfig) -> list[tuple[str, float, bool, bool]]:
    kinds = [("full", cfg.score(True, True), True, True), ("severity", cfg.score(True, False), True, False),
             ("location", cfg.score(False, True), False, True), ("category", cfg.score(False, False), False, False)]
    return sorted(kinds, key=lambda k: -k[1])


def gt_candidates(findings: DataFrame, issues: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """How many issues each finding reaches at each score of at least the minimum."""
    rows = [F.struct(F.lit(c).alias("confidence"), F.col(f"n_{k}").alias("n_issues")) for k, c, _, _ in _kinds(cfg) if c >= cfg.min_confidence]
    return _scored(findings, issues, cfg).select("finding_id", F.inline(F.array(*rows))).where("n_issues > 0")


def gt_match(findings: DataFrame, issues: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Best issue of every finding (highest score, first issue), null where none is good enough.

    A lower kind is used only when no higher one exists, so its first issue is the first of
    all issues that match at least that well.
    """
    best = None
    for k, conf, sev, loc in _kinds(cfg):
        if conf < cfg.min_confidence:
            continue
        label = "Exact" if sev and loc else "Partial" if sev or loc else "Weak"
        row = F.struct(F.lit(conf).alias("confidence"), F.lit(label).alias("match_type"), F.col(f"first_{k}").alias("issue"))
        best = F.when(F.col(f"n_{k}") > 0, row) if best is None else best.when(F.col(f"n_{k}") > 0, row)
    d = _scored(findings, issues, cfg).select("finding_id", "agent", "f_category", "f_severity", best.alias("b"))
    return d.select("finding_id", "agent", "f_category", "f_severity", "b.confidence", "b.match_type", "b.issue.*")


def with_verdict(matches: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    types = ["Exact", "Partial"] if cfg.partial_counts else ["Exact"]
    return matches.withColumn("is_tp", F.coalesce(F.col("match_type").isin(types), F.lit(False)))


def missed_issues(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    """Mandatory issues no finding reached."""
    hit = verdicts.where("is_tp").select("issue_id").distinct()
    return issues.where("is_mandatory").join(hit, "issue_id", "left_anti")


def gt_classify(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    found = verdicts.select(F.when(F.col("is_tp"), "true positive").otherwise("false positive").alias("verdict"),
                            F.col("finding_id").cast("string").alias("ref"), F.coalesce(F.when(F.col("is_tp"), F.col("issue_id")), F.lit("")).alias("issue_id"))
    miss = missed_issues(verdicts, issues).select(F.lit("false negative").alias("verdict"), F.lit("").alias("ref"), "issue_id")
    return found.unionByName(miss)


def _metrics(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = pct(tp, tp + fp), pct(tp, tp + fn)
    df = df.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * (F.col("p") * F.col("r")) / (F.col("p") + F.col("r"))).otherwise(0.0)
    out = df.withColumn("f1", F.round(f1, 4)).withColumn("accuracy", F.round(pct(tp, tp + fp + fn), 4))
    band = F.when(f1 >= 85, "EXCELLENT").when(f1 >= 75, "GOOD").when(f1 >= 65, "MODERATE").otherwise("LOW")
    return out.withColumn("quality", band).withColumn("precision", F.round("p", 4)).withColumn("recall", F.round("r", 4)).drop("p", "r")


def gt_metrics(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    found = verdicts.agg(F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"))
    miss = missed_issues(verdicts, issues).agg(F.count("*").alias("fn"))
    return _metrics(found.select("tp", "fp", miss.scalar().alias("fn")))


def gt_metrics_by_agent(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    """Misses are limited to issues the agent should find; counted, not paired."""
    agent = F.lower("agent")
    found = verdicts.groupBy(agent.alias("agent")).agg(F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"))
    must = issues.where("is_mandatory")
    everyone = must.agg(F.count_if(F.size("expected_agents") == 0).alias("n"))
    named = must.select("issue_id", F.explode(F.array_distinct(F.transform("expected_agents", lambda a: F.lower(a)))).alias("agent")).groupBy("agent").agg(F.count("*").alias("named"))
    ours = (F.size("expected_agents") == 0) | F.exists("expected_agents", lambda a: F.lower(a) == F.lower(F.col("agent")))
    hit = verdicts.where(F.col("is_tp") & F.col("is_mandatory") & ours).groupBy(agent.alias("agent")).agg(F.countDistinct("issue_id").alias("hit"))
    d = found.join(named, "agent", "left").join(hit, "agent", "left").withColumn("everyone", everyone.scalar())
    fn = F.col("everyone") + F.coalesce("named", F.lit(0)) - F.coalesce("hit", F.lit(0))
    return _metrics(d.select("agent", "tp", "fp", fn.alias("fn")))


def _by(verdicts: DataFrame, issues: DataFrame, issue_col: str, finding_col: str, tp_col: str) -> DataFrame:
    found = verdicts.select(F.when(F.col("is_tp"), F.col(tp_col)).otherwise(F.col(finding_col)).alias("k"),
                            F.col("is_tp").cast("int").alias("tp"), (~F.col("is_tp")).cast("int").alias("fp"), F.lit(0).alias("fn"))
    miss = missed_issues(verdicts, issues).select(F.col(issue_col).alias("k"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    return found.unionByName(miss).groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def gt_metrics_by_category(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    return _metrics(_by(verdicts, issues, "category", "f_category", "i_category").withColumnRenamed("k", "category"))


def gt_metrics_by_severity(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    levels = verdicts.sparkSession.createDataFrame([(s,) for s in SEVERITY_LEVELS], "severity string")
    d = _by(verdicts, issues, "severity", "f_severity", "i_severity").withColumnRenamed("k", "severity")
    return _metrics(levels.join(d, "severity", "left").fillna(0, ["tp", "fp", "fn"]))


def gt_top_errors(verdicts: DataFrame, issues: DataFrame, k: int = 5) -> DataFrame:
    """First k false positives and misses, with how many more there are."""
    fp = verdicts.where("NOT is_tp")
    fn = missed_issues(verdicts, issues)
    a = fp.orderBy("finding_id").limit(k).select(F.lit("false positive").alias("kind"), F.col("finding_id").cast("string").alias("ref"))
    b = fn.orderBy("issue_order").limit(k).select(F.lit("false negative").alias("kind"), F.col("issue_id").alias("ref"))
    more_a = F.greatest(fp.agg(F.count("*")).scalar() - k, F.lit(0))
    more_b = F.greatest(fn.agg(F.count("*")).scalar() - k, F.lit(0))
    return a.withColumn("more", more_a).unionByName(b.withColumn("more", more_b))
