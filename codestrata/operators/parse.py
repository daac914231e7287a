"""Raw answers to findings: JSON out of free text, prose forms, keyword readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..data import keywords as K
from ..functions.text import any_of, contains_ci, jre, strip
from ..session import cut_lineage

ANALYSIS_SCHEMA = (
    "confidenceScore int, businessImpact string, "
    "findings array<struct<category: string, description: string, severity: string, location: string, evidence: array<string>>>, "
    "recommendations array<struct<title: string, estimatedHours: double, priority: string>>"
)
SEMANTIC_SCHEMA = "semanticIssues array<struct<issueType: string, category: string, description: string, location: string, lineNumber: int, severity: int>>"
BATCH_SCHEMA = "analyses array<struct<fileName: string, assessment: string>>"
LENIENT = {"allowComments": "true", "mode": "PERMISSIVE"}
EVIDENCE_LIMIT = 3


def _valid(c: Column) -> Column:
    """The text if it is one whole JSON object or array.

    The parser stops after the first value, so the text is wrapped in brackets: anything
    after that value then breaks the parse or shows up as a second element.
    """
    t = strip(c)
    v = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    return F.when((t.startswith("{") | t.startswith("[")) & v.isNotNull() & F.try_variant_get(v, "$[1]", "string").isNull(), t)


def _no_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",(\s*[\]}])", "$1")


def _span(raw: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing mark."""
    return F.regexp_extract(raw, rf"(?s)({opening}.*{closing})", 1)


def _cleaned(raw: Column) -> Column:
    t = F.regexp_replace(strip(raw), r"(?im)^```\s*\w*\s*", "")
    t = F.regexp_replace(t, r"(?m)```\s*$", "")
    t = F.regexp_extract(t, r"(?s)([{\[].*[}\]])", 1)
    t = F.regexp_replace(t, r",(\s*[\]}])", "$1")
    t = F.replace(t, F.lit("'"), F.lit('"'))
    t = F.regexp_replace(t, r"(?m)//.*?$", "")
    return F.regexp_replace(t, r"(?s)/\*.*?\*/", "")


def extract_json(raw: Column) -> Column:
    """JSON text of an answer: whole, fenced, between outer marks, or after cleaning; null if none."""
    fenced = F.regexp_extract(raw, r"(?is)```\s*json\s*\n?(.*?)```", 1)
    generic = F.regexp_extract(raw, r"(?is)```\s*\w*\s*\n?(.*?)```", 1)
    outer = _span(raw, r"\{", r"\}")
    return F.coalesce(_valid(raw), _valid(fenced), _valid(generic), _valid(outer), _valid(_no_trailing_commas(outer)),
                      _valid(_span(raw, r"\[", r"\]")), _valid(_cleaned(raw)))


def structured(responses: DataFrame) -> DataFrame:
    """Answers with a usable analysis object (positive confidence), parsed once."""
    d = responses.withColumn("j", F.from_json(extract_json(F.col("raw")), ANALYSIS_SCHEMA, LENIENT))
    return d.where(F.col("j.confidenceScore") > 0)


def unstructured(responses: DataFrame) -> DataFrame:
    d = responses.withColumn("j", F.from_json(extract_json(F.col("raw")), ANALYSIS_SCHEMA, LENIENT))
    return d.where(F.coalesce(F.col("j.confidenceScore"), F.lit(0)) <= 0).drop("j")


def explode_analysis(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analyses, findings and recommendations of the structured answers, which are parsed once."""
    d = cut_lineage(structured(responses).select("response_id", "agent", "j"))
    analyses = d.select("response_id", "agent", F.col("j.confidenceScore").alias("confidence"), F.col("j.businessImpact").alias("impact"))
    none = F.array(F.struct(F.lit("Security").alias("category"), F.lit("No security issues were detected in the provided context.").alias("description"),
                            F.lit("LOW").alias("severity"), F.lit("").alias("location"), F.array().cast("array<string>").alias("evidence")))
    found = F.coalesce(F.col("j.findings"), F.expr("slice(j.findings, 1, 0)"))
    found = F.when((F.coalesce(F.size(found), F.lit(0)) <= 0) & (F.lower("agent") == "security"), none).otherwise(found)
    findings = d.select("response_id", "agent", F.inline(found))
    recs = d.select("response_id", "agent", F.inline("j.recommendations"))
    return analyses, findings, recs


def parse_semantic_issues(responses: DataFrame) -> DataFrame:
    raw = F.regexp_extract("raw", r'(\{[\s\S]*"semanticIssues"[\s\S]*\})', 1)
    d = responses.withColumn("k", F.from_json(_valid(raw), SEMANTIC_SCHEMA))
    return d.select("response_id", "expected_file", F.inline("k.semanticIssues"))


def match_batch_answers(responses: DataFrame, expected: str = "expected") -> DataFrame:
    """Answer per expected file: parsed entry by name or suffix, else the text after the name, else a default.

    ``expected`` is the response's own list of file names (one batch), so matching stays in the row.
    """
    body = _no_trailing_commas(_span(F.col("raw"), r"\{", r"\}"))
    parsed = F.from_json(body, BATCH_SCHEMA, LENIENT)["analyses"]
    d = responses.withColumn("entries", F.filter(parsed, lambda a: (a["fileName"] != "") & (a["assessment"] != "")))

    def answer(name: Column) -> Column:
        low = F.lower(name)
        fits = F.filter("entries", lambda a: (F.lower(a["fileName"]) == low) | low.endswith(F.lower(a["fileName"])) | F.lower(a["fileName"]).endswith(low))
        # a later entry for the same file replaces an earlier one
        hit = F.try_element_at(fits, F.lit(-1))["assessment"]
        at = F.instr(F.lower("raw"), low)
        after = F.substring(F.col("raw"), at + F.length(name), F.lit(2000))
        after = F.regexp_replace(strip(after), r"^[:\- \n\r]+", "")
        section = F.when((at > 0) & (F.length(after) > 50), F.substring(after, 1, 400))
        text = F.coalesce(hit, section, F.lit("Analysis completed. Detailed review recommended. (Parsed from batch response)"))
        source = F.when(hit.isNotNull(), "parsed").when(section.isNotNull(), "text").otherwise("default")
        return F.struct(name.alias("file_name"), text.alias("assessment"), source.alias("source"))

    return d.select("response_id", F.inline(F.transform(F.col(expected), answer)))


def prose_findings(responses: DataFrame) -> DataFrame:
    """Findings of prose answers: labelled, numbered or bulleted texts, else sentences that name a risk."""
    def texts(p: str, f: str) -> Column:
        return F.transform(F.regexp_extract_all("raw", F.lit(jre(p, f)), F.lit(1)), strip)

    labelled = F.filter(F.array_distinct(F.concat(*[texts(p, f) for p, f in K.PROSE_FORMS])), lambda x: x != "")
    sentences = F.transform(F.split("raw", r"(?<=[.!?])\s+"), strip)
    risky = F.array_distinct(F.filter(sentences, lambda x: x.rlike(jre(K.RISK_SENTENCE))))
    d = responses.withColumn("labelled", labelled)
    found = F.when(F.size("labelled") > 0, F.col("labelled")).otherwise(risky)
    return d.select("response_id", "agent", "raw", F.explode(found).alias("finding_text"))


def classify_finding(df: DataFrame, text: str = "finding_text", default: str = "agent") -> DataFrame:
    t = F.col(text)
    cat = None
    for word, label in K.CATEGORY_WORDS:
        cat = F.when(contains_ci(t, word), label) if cat is None else cat.when(contains_ci(t, word), label)
    sev = None
    for p, label in K.SEVERITY_WORDS:
        sev = F.when(t.rlike(jre(p)), label) if sev is None else sev.when(t.rlike(jre(p)), label)
    file = F.regexp_extract(t, jre(K.LOCATION_FILE), 1)
    line = F.regexp_extract(t, jre(K.LOCATION_FILE), 4)
    cls, met = F.regexp_extract(t, jre(r"class\s+(\w+)"), 1), F.regexp_extract(t, jre(r"method\s+(\w+)"), 1)
    location = (F.when(file != "", F.concat(file, F.when(line != "", F.concat(F.lit(" line "), line)).otherwise("")))
                .when(cls != "", F.concat(F.lit("Class "), cls)).when(met != "", F.concat(F.lit("Method "), met)).otherwise(""))
    return df.withColumn("category", cat.otherwise(F.col(default))).withColumn("severity", sev.otherwise("MEDIUM")).withColumn("location", location)


def finding_evidence(df: DataFrame, raw: str = "raw", text: str = "finding_text") -> DataFrame:
    """Code block after the finding, then up to 200 characters of the finding itself."""
    at = F.instr(F.lower(raw), F.lower(text))
    after = F.expr(f"substring({raw}, instr(lower({raw}), lower({text})))")
    block = strip(F.regexp_extract(after, r"```[a-zA-Z]*\s*([\s\S]+?)```", 1))
    parts = F.array_compact(F.array(F.when((at > 0) & (block != ""), block), F.substring(F.col(text), 1, 200)))
    return df.withColumn("evidence", F.array_distinct(parts))


def sentences_of(raw: Column) -> Column:
    return F.filter(F.split(raw, r"\."), lambda s: s != "")


def keyword_evidence(raw: Column, word: str) -> Column:
    hits = F.filter(sentences_of(raw), lambda s: F.lower(s).contains(word.lower()))
    return F.slice(F.transform(hits, strip), 1, EVIDENCE_LIMIT)


def _first_sentence(raw: Column, words: list[str]) -> Column:
    hits = F.filter(sentences_of(raw), lambda s: any_of([F.lower(s).contains(w.lower()) for w in words]))
    return F.get(hits, F.lit(0))


def _leveled(text: Column, table: list, default: str) -> Column:
    out = None
    for words, label in table:
        c = any_of([contains_ci(text, w) for w in words])
        out = F.when(c, label) if out is None else out.when(c, label)
    return out.otherwise(default)


def _by_agent(make) -> Column:
    out = None
    for spec in K.FINDING_WORDS:
        cond = F.lower("agent") == spec
        out = F.when(cond, make(spec)) if out is None else out.when(cond, make(spec))
    return out


def keyword_findings(responses: DataFrame) -> DataFrame:
    """One finding per keyword of the specialty that the answer holds."""
    raw = F.col("raw")

    def rows(spec: str) -> Column:
        items = []
        for category, word in K.FINDING_WORDS[spec]:
            context = F.coalesce(_first_sentence(raw, [word]), F.lit(""))
            items.append(F.when(contains_ci(raw, word), F.struct(
                F.lit(category).alias("category"), F.lit(category + K.FINDING_TEXT[spec]).alias("description"),
                _leveled(context, K.SENTENCE_SEVERITY, "LOW").alias("severity"),
                F.array_join(keyword_evidence(raw, word), " | ").alias("evidence"))))
        return F.array_compact(F.array(*items))

    return responses.select("response_id", "agent", F.inline(_by_agent(rows)))


def count_words(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = None
    for w in words:
        n = F.floor((F.length(low) - F.length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w))
        out = n if out is None else out + n
    return out


def keyword_scores(responses: DataFrame) -> DataFrame:
    raw = F.col("raw")

    def n_true(conds: list[Column]) -> Column:
        out = None
        for c in conds:
            v = F.when(c, 1).otherwise(0)
            out = v if out is None else out + v
        return out

    def confidence(spec: str) -> Column:
        conds = [contains_ci(raw, w) for w in [*K.CONFIDENCE_BASE, *K.CONFIDENCE_WORDS[spec]]]
        conds += [~raw.rlike(r"(?U)^\s*$"), F.length(raw) > K.CONFIDENCE_LENGTH[spec]]
        return F.least(F.lit(100), n_true(conds) * K.CONFIDENCE_STEP[spec])

    def effort(spec: str) -> Column:
        n = n_true([contains_ci(raw, w) for w in K.EFFORT_WORDS[spec]])
        out = F.lit(max(K.EFFORT_HOURS[spec].values()))
        for k, h in K.EFFORT_HOURS[spec].items():
            out = F.when(n == k, h).otherwise(out)
        return out

    def risk(spec: str) -> Column:
        n = n_true([contains_ci(raw, w) for w in K.RISK_WORDS[spec]])
        return F.element_at(F.array(*[F.lit(x) for x in K.RISK_LEVELS]), F.least(n, F.lit(3)) + 1)

    def impact(spec: str) -> Column:
        first = _first_sentence(raw, K.IMPACT_WORDS[spec])
        return F.coalesce(strip(first), F.lit(K.IMPACT_DEFAULT[spec]))

    def metric(i: int):
        return lambda spec: count_words(raw, K.METRIC_WORDS[spec][i][1])

    def metric_names(spec: str) -> Column:
        return F.lit(",".join(n for n, _ in K.METRIC_WORDS[spec]))

    return responses.select(
        "response_id", "agent", _by_agent(confidence).alias("confidence"), _by_agent(effort).alias("effort_hours"),
        _leveled(raw, K.PRIORITY_WORDS, "LOW").alias("priority"), _by_agent(risk).alias("risk"), _by_agent(metric_names).alias("metric_names"),
        *[_by_agent(metric(i)).alias(f"metric_{i + 1}") for i in range(3)], _by_agent(impact).alias("impact"))


def keyword_recommendations(responses: DataFrame) -> DataFrame:
    raw = F.col("raw")
    rows = [F.when((F.lower("agent") == spec) & any_of([contains_ci(raw, w) for w in words]), F.struct(
        F.lit(title).alias("title"), F.lit(hours).cast("decimal(12,2)").alias("hours"), F.lit(priority).alias("priority")))
        for spec, words, title, hours, priority in K.ADVICE]
    return responses.select("response_id", "agent", F.inline(F.array_compact(F.array(*rows))))
