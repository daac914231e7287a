"""Reconcile several reviewers: agreement, conflicts, priorities, team report.

Every group is first counted per (group, agent) or (group, priority): what is gathered into
one row is bounded by the number of agent kinds or priority levels, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .rollup import severity_rank

# agent weights in percent: whole numbers keep the weighted mean exact; parameters of ours
AGENT_WEIGHTS = {"security": 120, "performance": 100, "architectural": 110}
DEFAULT_WEIGHT = 100


def agreement(analyses: DataFrame) -> DataFrame:
    """Share of a project's analyses that carry its commonest priority."""
    per = analyses.groupBy("project", "priority").agg(F.count("*").alias("n"), F.min("analysis_id").alias("first"))
    d = per.groupBy("project").agg(F.sum("n").alias("analyses"), F.max(F.struct("n", (-F.col("first")).alias("o"), "priority")).alias("m"))
    return d.select("project", "analyses", F.col("m.priority").alias("top_priority"), F.round(F.col("m.n") / F.col("analyses") * 100.0, 4).alias("agreement_pct"))


def discussion(messages: DataFrame) -> DataFrame:
    """Messages, challenges, syntheses and duration per conversation."""
    sec = F.unix_seconds("ts")
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("type") == "Challenge").alias("conflicts"),
        F.count_if(F.col("type") == "Synthesis").alias("resolved"), (F.max(sec) - F.min(sec)).alias("duration_sec"))


def participation(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id", "from_agent").agg(F.count("*").alias("n"))


def consensus(messages: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row per conversation: agreement of its project and shape of its discussion."""
    talk = discussion(messages)
    who = participation(messages).groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("from_agent", "n"))), lambda x: F.concat(x["from_agent"], F.lit("="), x["n"].cast("string"))), ",").alias("participation"))
    a = agreement(analyses).withColumnRenamed("project", "conv_id")
    return talk.join(who, "conv_id").join(a, "conv_id", "left").select(
        "conv_id", "messages", "conflicts", "resolved", "duration_sec", "participation", F.coalesce("agreement_pct", F.lit(0.0)).alias("agreement_pct"))


def _weight() -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for word, w in reversed(list(AGENT_WEIGHTS.items())):
        out = F.when(F.lower("agent").contains(word), w).otherwise(out)
    return out


def team_confidence(analyses: DataFrame) -> DataFrame:
    w = _weight()
    d = analyses.groupBy("project").agg(F.sum(F.col("confidence") * w).alias("s"), F.sum(w).alias("w"))
    return d.select("project", F.bround(F.col("s") / F.col("w"), 0).cast("int").alias("confidence"))


def priority_conflicts(analyses: DataFrame) -> DataFrame:
    d = analyses.where(F.col("priority").isin("HIGH", "CRITICAL")).groupBy("project", "priority").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"))
    return d.where("n > 1")


def _with_agent(recs: DataFrame, analyses: DataFrame) -> DataFrame:
    return recs.join(analyses.select("analysis_id", "project", "agent", "is_error"), "analysis_id")


def title_conflicts(recs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Titles recommended more than once within a project."""
    d = _with_agent(recs, analyses).groupBy("project", "title").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"))
    return d.where("n > 1")


def synthesise_recs(recs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Recommendations of successful analyses by bucket, with hours, per project."""
    d = _with_agent(recs, analyses).where(~F.col("is_error"))
    p = F.upper(F.trim("priority"))
    bucket = F.when(p.isin("CRITICAL", "HIGH"), "high").when((p == "MEDIUM") | (p == "") | p.isNull(), "medium").when(p == "LOW", "long term")
    return d.withColumn("bucket", bucket).where("bucket IS NOT NULL").groupBy("project", "bucket").agg(
        F.count("*").alias("n"), F.sum("hours").alias("hours"))


def top_findings(findings: DataFrame, k: int = 2) -> DataFrame:
    """Most severe findings per agent; the rank filter is applied per task before the shuffle."""
    w = W.partitionBy("agent").orderBy(F.desc("rank"), "finding_id")
    d = findings.select("agent", "finding_id", "severity", "description", severity_rank(F.col("severity")).alias("rank"))
    return d.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def high_priority_count(findings: DataFrame) -> DataFrame:
    return findings.groupBy("agent").agg(F.count_if(F.upper("severity").isin("CRITICAL", "HIGH")).alias("high_priority"), F.count("*").alias("findings"))


def team_report(messages: DataFrame, analyses: DataFrame, recs: DataFrame) -> DataFrame:
    """One row per project: size, talk, agreement, confidence, buckets and hours."""
    talk = discussion(messages).select(F.col("conv_id").alias("project"), "messages")
    buckets = synthesise_recs(recs, analyses).groupBy("project").agg(
        *[F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b.replace(" ", "_")) for b in ["high", "medium", "long term"]],
        F.sum("hours").alias("hours"))
    d = agreement(analyses).join(team_confidence(analyses), "project").join(talk, "project", "left").join(buckets, "project", "left")
    return d.select("project", "analyses", F.coalesce("messages", F.lit(0)).alias("messages"), "agreement_pct", "confidence",
                    *[F.coalesce(b, F.lit(0)).alias(b) for b in ["high", "medium", "long_term"]], F.coalesce(F.col("hours").cast("double"), F.lit(0.0)).alias("hours"))
