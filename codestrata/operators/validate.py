"""Check findings against the code they speak about, and triage failed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..data import keywords as K
from ..functions.text import any_of, clamp, jre
from .graph import contradicted

# --- fixed values ---------------------------------------------------------------
FILE_IN_LOCATION = r"([\w\-_]+\.(cs|js|ts|py|java|cpp|h|cshtml|html|css|json|xml))"
LINE_FORMS = [r"line\s+(\d+)", r":(\d+)", r"line\s+\d+\s*-\s*(\d+)"]
WEIGHTS = (0.35, 0.35, 0.20, 0.10)

#: Texts and words that meet a file's code at a time.
PROBES = 512


def file_of(location: Column) -> Column:
    return F.regexp_extract(location, jre(FILE_IN_LOCATION), 1)


def lines_of(location: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(location, F.lit(jre(p)), F.lit(1)) for p in LINE_FORMS])
    return F.array_compact(F.array_distinct(F.transform(found, lambda x: x.try_cast("int"))))


def normal_code(text: Column) -> Column:
    """White space collapsed first, so a ``//`` comment reaches to the end of the text."""
    t = F.regexp_replace(text, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"//.*$", "")
    return F.trim(F.regexp_replace(t, r"/\*.*?\*/", ""))


def _normal(evidence: Column) -> Column:
    """Evidence as code is normalised; a missing text is an empty one."""
    return F.transform(evidence, lambda e: F.lower(normal_code(F.coalesce(e, F.lit("")))))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _supported(evidence: Column, found: Column) -> Column:
    """Every text is empty, found whole, or at least half of its words (rounded down, one at least) are found."""
    def one(n: Column) -> Column:
        words = _words(n)
        hits = F.size(F.filter(words, lambda w: F.array_contains(found, w)))
        return (n == "") | F.array_contains(found, n) | ((F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))))

    return F.forall(_normal(evidence), one)


def evidence_support(claims: DataFrame, code: DataFrame, per_block: int = PROBES) -> DataFrame:
    """``claims``: file_key, evidence; ``code``: file_key, version, code. Gives file_key, version, evidence, supported.

    What the claims about a file ask for, whole texts and words, is gathered without repeats and cut into blocks of
    about ``per_block``. A block meets the file's code once and only what was found goes on, so code is never
    copied to claims, and a file that most claims speak about is many blocks.
    """
    asked = F.array_distinct(F.flatten(F.transform(_normal(F.col("evidence")), lambda n: F.concat(F.array(n), _words(n)))))
    c = claims.distinct().withColumn("probe", F.explode(F.filter(asked, lambda p: p != "")))
    probes = c.select("file_key", "probe").distinct()
    blocks = probes.groupBy("file_key").agg(F.ceil(F.count("*") / per_block).alias("n"))
    blocks = probes.join(blocks, "file_key").withColumn("block", F.pmod(F.xxhash64("probe"), F.col("n")))
    blocks = blocks.groupBy("file_key", "block").agg(F.collect_list("probe").alias("probes"))
    hits = blocks.join(code, "file_key").select("file_key", "version", F.explode(F.filter("probes", lambda p: F.col("code").contains(p))).alias("probe"))
    found = c.join(hits.distinct(), ["file_key", "probe"]).groupBy("file_key", "version", "evidence").agg(F.collect_set("probe").alias("found"))
    return found.select("file_key", "version", "evidence", _supported(F.col("evidence"), F.col("found")).alias("supported"))


def severity_fits(category: Column, severity: Column) -> Column:
    cat, sev = F.lower(category), F.upper(F.trim(severity))
    out = F.when(F.coalesce(F.trim(category), F.lit("")) == "", True).when(F.coalesce(severity, F.lit("")) == "", True)
    for word, allowed in K.EXPECTED_SEVERITIES:
        out = out.when(cat.contains(word.lower()), sev.isin(allowed))
    inflated = (sev == "CRITICAL") & ~any_of([cat.contains(w.lower()) for w in K.INFLATION_EXEMPT])
    return out.otherwise(~inflated)


def validate_findings(findings: DataFrame, contents: DataFrame) -> DataFrame:
    """``contents``: file_key, content. Files nobody speaks about are dropped before the join.

    Findings meet the number of lines and the verdict on their evidence; code meets blocks of words.
    """
    f = findings.withColumn("file_key", file_of(F.col("location"))).withColumn("named", lines_of(F.col("location")))
    f = f.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    spoken = f.select("file_key").where("file_key <> ''").distinct()
    c = contents.join(spoken, "file_key", "left_semi").withColumn("version", F.xxhash64("content"))
    slim = c.select("file_key", "version", F.size(F.split("content", r"\r\n|\r|\n", -1)).alias("n_lines"))
    code = c.dropDuplicates(["file_key", "version"]).select("file_key", "version", F.lower(normal_code(F.col("content"))).alias("code"))
    claims = f.where((F.col("file_key") != "") & (F.size("evidence") > 0)).select("file_key", "evidence")
    d = f.join(slim, "file_key", "left").join(evidence_support(claims, code), ["file_key", "version", "evidence"], "left")
    has = F.col("n_lines").isNotNull()
    in_range = F.forall("named", lambda n: (n >= 1) & (n <= F.col("n_lines")))
    d = d.withColumn("line_valid", has & ((F.size("named") == 0) | in_range))
    # claims of which nothing was found are not in the verdicts; those that ask for nothing hold
    holds = F.coalesce("supported", _supported(F.col("evidence"), F.array().cast("array<string>")))
    d = d.withColumn("evidence_present", has & (F.size("evidence") > 0) & holds)
    d = d.withColumn("severity_fits", severity_fits(F.col("category"), F.col("severity")))
    failed = has & (F.size("named") > 0) & ~in_range
    warned = ~has | (F.size("named") == 0) | ~F.col("line_valid") | ~F.col("evidence_present") | ~F.col("severity_fits")
    status = F.when(failed, "Failed").when(warned, "LowConfidence").otherwise("Validated")
    return d.select("finding_id", "file_key", "line_valid", "evidence_present", "severity_fits", status.alias("status"))


def validation_status(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """Validated findings that take part in a contradiction drop to low confidence."""
    hit = contradicted(findings).withColumn("contradicted", F.lit(True))
    d = checks.join(hit, "finding_id", "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    return d.withColumn("final_status", F.when(F.col("contradicted") & (F.col("status") == "Validated"), "LowConfidence").otherwise(F.col("status")))


def overall_confidence(parts: Column) -> Column:
    total = parts[0] * WEIGHTS[0] + parts[1] * WEIGHTS[1] + parts[2] * WEIGHTS[2] + parts[3] * WEIGHTS[3]
    return F.bround(total, 0).cast("int")


def normalise_confidence(df: DataFrame, score: str = "score", parts: str = "parts") -> DataFrame:
    """Clamp scores; a zero score is taken from its parts; a missing one is 50."""
    clamped = F.transform(F.col(parts), lambda p: clamp(p, 0, 100))
    s = clamp(F.col(score), 0, 100)
    value = F.when(F.col(score).isNull(), 50).when(s == 0, overall_confidence(clamped)).otherwise(s)
    new_parts = F.when(F.col(score).isNull(), F.transform(clamped, lambda p: F.lit(50))).otherwise(clamped)
    d = df.withColumn("confidence", value).withColumn("clamped", new_parts)
    return d.withColumn("level", F.when(F.col("confidence") >= 90, "High").when(F.col("confidence") >= 60, "Medium").otherwise("Low"))


def renumber_steps(steps: Column) -> Column:
    return F.transform(steps, lambda x, i: x.withField("step_number", i + 1))


def error_triage(log: DataFrame) -> DataFrame:
    """``log``: error_type, message. The first rule that fits decides."""
    pick = None
    for etype, words, retry, delay, group in K.ERROR_RULES:
        cond = F.lit(True) if etype is None else F.col("error_type") == etype
        if words:
            cond = cond & any_of([F.lower("message").contains(w) for w in words])
        row = F.struct(F.lit(retry).alias("retryable"), F.lit(delay).alias("delay_seconds"), F.lit(group).alias("remedy"))
        pick = F.when(cond, row) if pick is None else pick.when(cond, row)
    code = F.concat(F.lit("ERR-"), F.upper(F.substring("error_type", 1, 3)), F.lit("-"), F.upper(F.substring(F.md5("error_type"), 1, 8)))
    return log.withColumn("t", pick).select("log_id", "error_type", code.alias("error_code"), "t.*")


def partial_gate(runs: DataFrame, minimum: int = 2) -> DataFrame:
    d = runs.groupBy("project").agg(F.count("*").alias("agents"), F.count_if(~F.col("is_error")).alias("succeeded"), F.count_if("is_error").alias("failed"))
    keep = F.col("succeeded") >= minimum
    return d.withColumn("keep_partial", keep).withColumn("outcome", F.when(F.col("failed") == 0, "complete").when(keep, "partial").otherwise("failed"))
