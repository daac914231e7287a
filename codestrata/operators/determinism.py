"""Compare repeated runs: which findings come back, how often, how alike two runs are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import running
from ..functions.text import jre

def finding_key(category: Column, location: Column) -> Column:
    loc = F.regexp_replace(F.lower(F.coalesce(location, F.lit(""))), jre(r":\d+", ""), ":*")
    loc = F.regexp_replace(loc, jre(r"line\s+\d+", ""), "line *")
    return F.concat_ws("|", F.lower(F.coalesce(category, F.lit(""))), loc)


def with_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_key", finding_key(F.col("category"), F.col("location")))


def _digest(text: Column) -> Column:
    return F.substring(F.base64(F.unhex(F.sha2(text, 256))), 1, 16)


def run_hash(findings: DataFrame) -> DataFrame:
    """Order-sensitive hash of each run, the same for any size.

    Every finding is hashed with its place in the run; the hashes add up, and count and sum are hashed.
    Sums are partial, so no task or row ever holds a whole run.
    """
    text = F.concat_ws(":", "category", "severity", "location")
    d = running(findings.select("run_number", "finding_id", text.alias("t")), ["run_number"], ["finding_id"], {"pos": F.lit(1)})
    part = F.conv(F.substring(F.md5(F.concat_ws("|", "pos", "t")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = d.groupBy("run_number").agg(F.count("*").alias("findings"), F.sum(part).alias("s"))
    return sums.select("run_number", "findings", _digest(F.concat_ws(":", "findings", "s")).alias("run_hash"))


def run_consistency(findings: DataFrame, run_count: int, threshold: float = 80.0, by: list[str] | None = None) -> DataFrame:
    """Per key: appearances (repeats within one run count), rate, severities seen."""
    d = with_key(findings).groupBy("finding_key", *(by or [])).agg(
        F.count("*").alias("appearances"), F.countDistinct("run_number").alias("runs_seen"),
        F.min(F.struct("run_number", "finding_id", "category")).alias("f"),
        F.array_sort(F.collect_set("severity")).alias("sev"))
    rate = F.col("appearances") / F.lit(run_count) * 100.0
    return d.select("finding_key", *(by or []), "appearances", "runs_seen", F.col("f.category").alias("category"), rate.alias("rate"),
                    (rate >= threshold).alias("is_consistent"), F.array_join("sev", ",").alias("severities"),
                    (F.size("sev") == 1).alias("one_severity"))


def run_score(consistency: DataFrame) -> DataFrame:
    s = F.coalesce(F.sum("appearances") / F.count("*"), F.lit(0.0))
    d = consistency.agg(F.count("*").alias("keys"), F.coalesce(F.avg("rate"), F.lit(0.0)).alias("score"))
    level = (F.when(F.col("score") >= 90, "Excellent").when(F.col("score") >= 80, "Good").when(F.col("score") >= 70, "Moderate")
             .when(F.col("score") >= 60, "Fair").otherwise("Poor"))
    return d.select("keys", F.round("score", 4).alias("score"), level.alias("level"))


def run_by(consistency: DataFrame, col: str) -> DataFrame:
    """Share of consistent keys; groups without any consistent key are not listed."""
    d = consistency.groupBy(col).agg(F.count_if("is_consistent").alias("consistent"), F.count_if(~F.col("is_consistent")).alias("inconsistent"))
    return d.where("consistent > 0").withColumn("score", F.round(F.col("consistent") / (F.col("consistent") + F.col("inconsistent")) * 100.0, 4))


def run_stats(findings: DataFrame, consistency: DataFrame, run_count: int) -> DataFrame:
    r = F.col("rate")
    keys = consistency.agg(
        F.count("*").alias("keys"), F.count_if(F.col("is_consistent") & (r == 100)).alias("full"),
        F.count_if(F.col("is_consistent") & (r >= 80)).alias("high"), F.count_if(F.col("is_consistent") & (r >= 50) & (r < 80)).alias("moderate"),
        F.count_if((r >= 50) & (r < 80)).alias("moderate_band"), F.count_if(~F.col("is_consistent") & (r < 50)).alias("poor"))
    runs = findings.sparkSession.range(1, run_count + 1).select(F.col("id").cast("int").alias("run_number"))
    sizes = runs.join(findings.groupBy("run_number").agg(F.count("*").alias("n")), "run_number", "left").fillna(0, ["n"])
    per = sizes.agg(F.round(F.avg("n"), 4).alias("avg_findings"), F.min("n").alias("min_findings"), F.max("n").alias("max_findings"),
                    F.round(F.stddev_pop("n"), 4).alias("sd_findings"))
    both = [keys.withColumn("side", F.lit("keys")), per.withColumn("side", F.lit("runs"))]
    one = both[0].unionByName(both[1], allowMissingColumns=True)
    return one.agg(*[F.max(c).alias(c) for c in one.columns if c != "side"])


def run_similarity(findings: DataFrame) -> DataFrame:
    """Jaccard percentage of every pair of runs.

    Keys are first reduced to the set of runs they occur in, and equal sets are counted, so
    the pair list grows with the number of different run sets and not with the keys.
    """
    d = with_key(findings).select("run_number", "finding_key").distinct()
    # a set holds each run at most once: bounded by the number of runs
    sets = d.groupBy("finding_key").agg(F.array_sort(F.collect_set("run_number")).alias("runs")).groupBy("runs").agg(F.count("*").alias("n"))
    pairs = F.flatten(F.transform("runs", lambda a: F.transform(F.filter("runs", lambda b: b > a), lambda b: F.struct(a.alias("run_a"), b.alias("run_b")))))
    common = sets.select("n", F.inline(pairs)).groupBy("run_a", "run_b").agg(F.sum("n").alias("common"))
    size = d.groupBy("run_number").agg(F.count("*").alias("size"))
    a = size.select(F.col("run_number").alias("run_a"), F.col("size").alias("size_a"))
    b = size.select(F.col("run_number").alias("run_b"), F.col("size").alias("size_b"))
    # all pairs of runs are the result asked for; the number of runs is the caller's choice
    # the run list is one row, so the pairs are unfolded from it
    runs = size.agg(F.array_sort(F.collect_list("run_number")).alias("runs")).select(F.inline(pairs))
    out = runs.join(a, "run_a").join(b, "run_b").join(common, ["run_a", "run_b"], "left").fillna(0, ["common"])
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return out.select("run_a", "run_b", "common", union.alias("all_keys"), F.round(F.col("common") / union * 100.0, 4).alias("similarity"))
