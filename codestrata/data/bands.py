"""Threshold bands as rows: measure, lower bound (inclusive), upper bound (exclusive), label.

Scores are whole numbers, so "more than 70" reads as lower bound 71. Fixed values.
"""

from __future__ import annotations


def _ladder(measure: str, cuts: list[float], labels: list[str]) -> list[tuple[str, float | None, float | None, str, int]]:
    bounds = [float(c) for c in cuts]
    lows, highs = [None, *bounds], [*bounds, None]
    return [(measure, lo, hi, label, i) for i, (lo, hi, label) in enumerate(zip(lows, highs, labels, strict=True), 1)]


BANDS = [
    *_ladder("risk level", [30, 60], ["LOW", "MEDIUM", "HIGH"]),
    *_ladder("risk statistics", [40, 70], ["low", "medium", "high"]),
    *_ladder("complexity label", [30, 50], ["Low Risk", "Medium Risk", "High Risk"]),
    *_ladder("status text", [31, 51], ["Good", "Monitor", "Needs Review"]),
    *_ladder("maintenance level", [31, 51], ["Standard maintenance", "Scheduled review", "Immediate attention"]),
    *_ladder("migration timeline", [30, 50, 70], [
        "2-4 weeks (Low complexity migration)", "4-8 weeks (Standard migration process)",
        "8-16 weeks (Complex migration - phased approach)", "16+ weeks (High complexity - dedicated team required)"]),
    *_ladder("resource requirements", [30, 50, 70], [
        "1-2 developers, standard skillset", "2-3 developers, experienced team", "3-5 developers, senior expertise required",
        "5+ developers, specialist migration team with architect oversight"]),
    *_ladder("financial impact", [30, 50, 70], [
        "Low cost - standard development rates", "Moderate cost - budget for quality assurance",
        "High cost - include risk mitigation budget", "Very high cost - executive approval recommended"]),
    *_ladder("executive timeline", [30, 50, 70], [
        "2-4 weeks (Low complexity migration)", "4-8 weeks (Standard migration process)",
        "8-12 weeks (Complex migration - phased approach)", "12+ weeks (High complexity - dedicated team required)"]),
    *_ladder("cost estimate", [31, 51, 71], ["$10K-25K", "$25K-75K", "$75K-150K", "$150K-300K"]),
    *_ladder("roi timeline", [31, 61], [
        "3-6 months (immediate productivity and maintenance benefits)", "6-12 months (medium-term operational improvements)",
        "12-18 months (long-term strategic investment)"]),
    *_ladder("complexity risk", [41, 71], [
        "Low risk - Standard complexity suitable for normal development practices",
        "Medium risk - Moderate complexity manageable with experienced team",
        "High risk - Complex codebase requires specialist expertise and careful planning"]),
    *_ladder("resource risk", [31, 61], [
        "Low risk - Can be completed with existing team capabilities",
        "Medium risk - Standard resource planning and skill mix adequate",
        "High risk - Requires experienced team and may compete for limited senior resources"]),
    *_ladder("timeline risk", [41, 71], [
        "Low risk - Straightforward implementation with predictable timeline",
        "Medium risk - Standard project management practices should maintain timeline adherence",
        "High risk - Complex project with potential for scope creep and timeline extension"]),
    *_ladder("file count", [5, 15, 30], [
        "Small project scope", "Medium project complexity", "Large project - requires structured approach",
        "Enterprise-scale project - dedicated team recommended"]),
    *_ladder("class count", [10, 25, 50], [
        "Low structural complexity", "Moderate architectural complexity", "Complex architecture - careful planning required",
        "Highly complex system - expert analysis recommended"]),
    *_ladder("method count", [50, 150, 300], [
        "Manageable codebase size", "Medium codebase - standard development practices apply",
        "Large codebase - requires systematic approach", "Very large codebase - enterprise development practices essential"]),
    *_ladder("business impact", [21, 51, 101], [
        "LOW IMPACT - Supporting component appropriate for junior developer development",
        "MODERATE IMPACT - Standard business system suitable for normal development processes",
        "MEDIUM IMPACT - Important business component requiring experienced team and proper planning",
        "HIGH IMPACT - Core business system requiring executive oversight and structured approach"]),
    *_ladder("operational risk", [51, 101], [
        "Low risk - Supporting functionality with minimal business impact",
        "Medium risk - Important business operations require structured testing approach",
        "High risk - Core business functionality requires careful change management"]),
    *_ladder("dependency risk", [9, 16], [
        "Low risk - Minimal external dependencies simplify modernization process",
        "Medium risk - Standard dependency management practices required",
        "High risk - Extensive dependencies require careful compatibility analysis"]),
    *_ladder("scale risk", [11, 26], [
        "Low risk - Small codebase suitable for agile development approach",
        "Medium risk - Standard project management practices adequate",
        "High risk - Large codebase requires structured approach and dedicated team"]),
    *_ladder("modernization roi", [6, 11, 21], [
        "LOW ROI - Consider as part of broader modernization initiative",
        "LOW-MEDIUM ROI - Benefits primarily in code maintainability and developer productivity",
        "MEDIUM ROI - Moderate benefits from improved maintainability and performance",
        "HIGH ROI - Significant operational and maintenance cost savings expected"]),
    *_ladder("technical debt", [9, 16, 26], [
        "MINIMAL - Current code practices appear to manage technical debt effectively",
        "LOW - Well-maintained codebase with minimal technical debt accumulation",
        "MODERATE - Some architectural improvements needed to optimize maintainability",
        "SUBSTANTIAL - Significant refactoring required to address accumulated technical debt"]),
    *_ladder("migration complexity", [201, 501, 1001], [
        "LOW - Straightforward migration using standard development practices",
        "MEDIUM - Standard migration complexity suitable for experienced development team",
        "HIGH - Complex migration requiring dedicated team with migration expertise",
        "VERY HIGH - Enterprise-scale migration requiring specialized methodology and tools"]),
    *_ladder("strategic priority", [51, 101, 201], [
        "LOW - Can be included in regular development cycle",
        "MEDIUM - Standard project management and skilled developers appropriate",
        "HIGH - Senior management oversight and experienced team necessary",
        "CRITICAL - Executive approval and dedicated team required"]),
]
BAND_SCHEMA = "measure string, lo double, hi double, label string, rank int"
