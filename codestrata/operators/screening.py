"""Filters and screens over files and free text (no shuffle anywhere)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hints import required_words
from ..functions.text import LANGUAGES, any_of, base_name, chosen, finds, jre, low_text, pin

# --- fixed values ----------------------------------------------------------
GENERATED_MARKS = [".Designer.", ".g.cs", ".g.i.cs", "AssemblyInfo.cs", "\\bin\\", "\\obj\\", "/bin/", "/obj/"]
ALLOWED_EXTENSIONS = ["cs", "py", "js", "ts", "java", "go", "vb", "fs", "cpp", "h"]
FORBIDDEN_NAME_CHARACTERS = ["<", ">", ":", '"', "/", "\\", "|", "?", "*", "\x00"]
MAX_FILE_NAME = 255
MAX_FILE_BYTES = 5 * 1024 * 1024
SUSPICIOUS = [
    r"eval\s*\(", r"exec\s*\(", r"system\s*\(", r"shell_exec\s*\(", r"base64_decode\s*\(", r"gzinflate\s*\(",
    r"str_rot13\s*\(", r"<script[^>]*>", r"javascript:", r"onerror\s*=", r"onload\s*=",
]
PROMPT_INJECTION = [
    r"ignore\s+(previous|above|all)\s+instructions", r"forget\s+(everything|all|previous)", r"you\s+are\s+now",
    r"system\s*[:=]\s*", r"assistant\s*[:=]\s*", r"user\s*[:=]\s*", r"<\|(system|user|assistant)\|>", r"\[INST\]", r"\[/INST\]",
]
FORBIDDEN_TEXT = ["\x00", "\r\n", "\n\r"]
MAX_PROMPT = 2000
REDACTIONS = [
    r"""(api[_-]?key|apikey)\s*[:=]\s*["']?([a-zA-Z0-9\-_]{20,})["']?""",
    r"""(password|pwd|pass)\s*[:=]\s*["']?([^"'\s]{3,})["']?""",
    r"""(token|secret|secretkey)\s*[:=]\s*["']?([a-zA-Z0-9\-_]{20,})["']?""",
    r"""(connectionstring|connstr)\s*[:=]\s*["']?([^"']{20,})["']?""",
    r"""(authorization|bearer)\s+([a-zA-Z0-9\-_\.]{20,})""",
    r"""(x-api-key|x-auth-token)\s*[:=]\s*["']?([a-zA-Z0-9\-_]{20,})["']?""",
]
REDACTED = "[REDACTED]"
MAX_MESSAGE = 5000
MAX_SNIPPET = 100
FORBIDDEN_FIELDS = ["code", "codeContent", "fileContent", "fullCode", "sourceCode", "apiKey", "password", "token", "secret",
                    "connectionString"]
CODE_MARKS = ["{", "}", "(", ")", ";", "=", "var ", "function ", "class ", "public ", "private ", "using ", "import ", "def ",
              "return ", "if ", "for ", "while "]


def filter_source_files(files: DataFrame, name: str = "file_name", extensions=tuple(LANGUAGES)) -> DataFrame:
    n = F.col(name)
    keep = any_of([F.lower(n).endswith("." + e) for e in extensions])
    temporary = F.lower(base_name(n)).startswith("temp")
    return files.where(keep & ~temporary & ~any_of([n.contains(m) for m in GENERATED_MARKS]))


def screen_files(files: DataFrame, name: Column | None = None, size: Column | None = None) -> DataFrame:
    """First failing check names the reason; null reason means the file passes."""
    n = name if name is not None else base_name(F.col("file_name"))
    s = size if size is not None else F.col("size")
    ext = F.regexp_extract(F.lower(n), r"\.([^.]+)$", 1)
    reason = (
        F.when(n.isNull() | (F.trim(n) == ""), "empty name")
        .when(F.length(n) > MAX_FILE_NAME, "name too long")
        .when(any_of([n.contains(c) for c in FORBIDDEN_NAME_CHARACTERS]), "forbidden character")
        .when(~ext.isin(ALLOWED_EXTENSIONS), "extension not allowed")
        .when(s > MAX_FILE_BYTES, "file too large")
    )
    return files.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def scan_suspicious(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Files that hold suspicious patterns, over the whole text."""
    found = chosen([(p, finds(F.col("content"), F.col("_low"), p)) for p in (patterns or SUSPICIOUS)])
    d = pin(files.select("file_name", "content", low_text(F.col("content")).alias("_low")), found.alias("patterns"))
    return d.select("file_name", "patterns").where(F.size("patterns") > 0)


def screen_prompts(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    reason = (
        F.when(t.isNull() | t.rlike(r"(?U)^\s*$"), "empty")
        .when(F.length(t) > MAX_PROMPT, "too long")
        .when(any_of([t.contains(x) for x in FORBIDDEN_TEXT]), "forbidden character")
        .when(any_of([finds(t, low_text(t), p) for p in PROMPT_INJECTION]), "injection")
    )
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def redact_text(text: Column, max_len: int | None = MAX_MESSAGE) -> Column:
    """Secrets replaced, then cut to ``max_len`` (None: whole)."""
    low, out = low_text(text), text
    for p in REDACTIONS:
        # a replacement adds no word any later pattern needs, so the first lower-case copy serves them all
        words = required_words(p)
        cut = F.regexp_replace(out, jre(p), "$1: " + REDACTED.replace("[", r"\[").replace("]", r"\]"))
        out = F.when(any_of([low.contains(w) for w in words]), cut).otherwise(out) if words else cut
    if max_len is None:
        return out
    return F.when(F.length(out) > max_len, F.concat(F.substring(out, 1, max_len), F.lit("... [TRUNCATED]"))).otherwise(out)


def code_like(text: Column) -> Column:
    low = F.lower(text)
    marks = [F.when(low.contains(m), 1).otherwise(0) for m in CODE_MARKS]
    n = marks[0]
    for m in marks[1:]:
        n = n + m
    return (F.length(text) >= 20) & (F.trim(text) != "") & (n >= 3)


def file_like(text: Column) -> Column:
    return (F.length(text) >= 50) & (F.trim(text) != "") & (
        (F.length(text) > 200) | text.contains("\n") | text.contains("\r"))


def cut_snippet(text: Column) -> Column:
    return F.when(F.length(text) <= MAX_SNIPPET, text).otherwise(
        F.concat(F.substring(text, 1, MAX_SNIPPET), F.lit("... [CODE REDACTED - "), F.length(text).cast("string"), F.lit(" chars total]")))


def mask_fields(fields: Column) -> Column:
    """Values of forbidden field names are replaced; the rest is cut or redacted."""
    def one(k: Column, v: Column) -> Column:
        forbidden = any_of([F.lower(k).contains(w.lower()) for w in FORBIDDEN_FIELDS])
        return F.when(forbidden, F.lit(REDACTED)).when(code_like(v) | file_like(v), cut_snippet(v)).otherwise(redact_text(v))
    return F.transform_values(fields, one)


def keep_files(meta: DataFrame, by: str, min_complexity: int = 15) -> DataFrame:
    """``meta`` carries security_hits, performance_hits and cyclomatic per file."""
    return meta.where(_keep(by, min_complexity))


def _keep(by: str, min_complexity: int = 15) -> Column:
    return {
        "security": F.col("security_hits") > 0,
        "complexity": F.col("cyclomatic") >= min_complexity,
        "performance": F.col("performance_hits") > 0,
    }[by]


def keep_report(meta: DataFrame, min_complexity: int = 15) -> DataFrame:
    """Kept files and reduction per filter, in one pass over ``meta``."""
    kinds = ["security", "complexity", "performance"]
    one = meta.agg(F.count("*").alias("total"), *[F.count_if(_keep(k, min_complexity)).alias(k) for k in kinds])
    rows = F.array(*[F.struct(F.lit(k).alias("filter_name"), F.col("total"), F.col(k).alias("kept")) for k in kinds])
    return one.select(F.inline(rows)).withColumn(
        "reduction_pct", F.when(F.col("total") > 0, F.round((F.col("total") - F.col("kept")) / F.col("total") * 100.0, 4)).otherwise(0.0))


def specialty_view(meta: DataFrame, specialty: str) -> DataFrame:
    """Rows a specialty should see; all rows where its filter finds none."""
    by = {"security": "security", "performance": "complexity"}.get(specialty)
    if by is None:
        return meta
    kept = meta.where(_keep(by))
    return meta.where(_keep(by) | ~kept.exists())
