"""Rule scan: every rule becomes a literal pattern, so one pass over the text serves all rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..data.rules import ALL_RULES, Rule
from ..functions.text import finds_sql, jre, low_text, pin, sql_text


def rule_sql(rule: Rule) -> str:
    """Condition over ``content`` and its lower-case copy ``_low``."""
    def find(p: str) -> str:
        return finds_sql("content", "_low", p, rule.flags)

    if rule.min_count:
        cond = f"regexp_count(content, {sql_text(jre(rule.must[0], rule.flags))}) > {rule.min_count}"
    else:
        cond = "(" + " OR ".join(find(p) for p in rule.must) + ")"
    cond += "".join(f" AND {find(p)}" for p in rule.also)
    return cond + "".join(f" AND NOT {find(p)}" for p in rule.must_not)


def _hits(rules: Iterable[Rule]) -> Column:
    """Needs ``content``, ``_low`` and ``language``. Array of the rules that fire; rules of other languages are not even tested."""
    groups: dict[tuple[str, ...], list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.languages, []).append(r)
    cases = []
    for langs, members in groups.items():
        arr = ", ".join(f"CASE WHEN {rule_sql(r)} THEN named_struct('rule_id', {sql_text(r.rule_id)}, 'family', {sql_text(r.family)}, "
                        f"'severity', {sql_text(r.severity)}) END" for r in members)
        cases.append(f"WHEN language IN ({', '.join(sql_text(x) for x in langs)}) THEN array_compact(array({arr}))")
    return F.expr("CASE " + " ".join(cases) + " END")


def rule_scan(files: DataFrame, rules: list[Rule] | None = None, extra: list[str] | None = None) -> DataFrame:
    """One row per (file, rule) that fires."""
    d = files.withColumn("_low", low_text(F.col("content")))
    return d.select("file_name", "language", *(extra or []), F.inline(_hits(rules if rules is not None else ALL_RULES)))


def hit_counts(content_df: DataFrame, rules: list[Rule] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Hits per family as columns of the file row: no explode, no shuffle."""
    hits = _hits(rules if rules is not None else ALL_RULES)
    df = pin(content_df.withColumn("_low", low_text(F.col("content"))), hits.alias("hits"))

    def n(fam: str) -> Column:
        return F.coalesce(F.size(F.filter("hits", lambda h: h["family"] == fam)), F.lit(0)).alias(f"{fam}_hits")

    return df.select("file_name", "language", *(extra or []), n("security"), n("performance"), n("architecture"))


# --- rules as rows ----------------------------------------------------------
RULE_SCHEMA = ("rule_id string, language string, family string, severity string, must string, also string, "
               "must_not string, min_count int")


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows, one per language; alternatives are joined into one pattern."""
    def joined(ps: tuple[str, ...], flags: str) -> str | None:
        return jre("|".join(f"(?:{p})" for p in ps), flags) if ps else None
    rows = [(r.rule_id, lang, r.family, r.severity, joined(r.must, r.flags), joined(r.also, r.flags),
             joined(r.must_not, r.flags), r.min_count) for r in rules for lang in r.languages]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def register_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Add or replace: the new rows own every language they mention."""
    return rules.join(new.select("language").distinct(), "language", "left_anti").unionByName(new)


def rule_scan_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Same scan for a rule table known only at run time: equi join on language, pattern as residual.

    The planner broadcasts the rules if their size is known to be small.
    """
    fires = (
        (F.regexp_count("content", F.col("must")) > F.col("min_count"))
        & (F.col("also").isNull() | F.expr("content RLIKE also"))
        & (F.col("must_not").isNull() | ~F.expr("content RLIKE must_not"))
    )
    return files.join(rules, "language").where(fires).select("file_name", "language", "rule_id", "family", "severity")
