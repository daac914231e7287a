"""Column expressions over text. Everything here stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .hints import required_words


def jre(pattern: str, flags: str = "i") -> str:
    r"""Java form of a rule pattern: Unicode classes, ``.`` stops at ``\n`` only."""
    return f"(?Ud{flags})" + pattern


def sql_text(s: str) -> str:
    """A Spark SQL string literal: one parsed expression is cheaper to build than many calls.

    ``$`` is written as an escape, else ``${name}`` would be taken for a variable.
    """
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("$", "\\u0024") + "'"


def text_array(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def pin(df: DataFrame, *cols: Column) -> DataFrame:
    """Add computed columns behind a Generate, so that a later filter on them is not pushed
    below and does not evaluate an expensive expression twice."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def has(text: Column, pattern: str, flags: str = "i") -> Column:
    return text.rlike(jre(pattern, flags))


def low_text(text: Column) -> Column:
    """Lower case for the pre-tests; signs that patterns fold onto ASCII letters are folded here, too."""
    return F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))


def finds(text: Column, low: Column, pattern: str, flags: str = "i") -> Column:
    """``has`` behind a substring pre-test on ``low``, the ``low_text`` of the text."""
    words = required_words(pattern)
    cond = has(text, pattern, flags)
    return any_of([low.contains(w) for w in words]) & cond if words else cond


def finds_sql(text: str, low: str, pattern: str, flags: str = "i") -> str:
    words = required_words(pattern)
    cond = f"{text} RLIKE {sql_text(jre(pattern, flags))}"
    return f"(({' OR '.join(f'contains({low}, {sql_text(w)})' for w in words)}) AND {cond})" if words else f"({cond})"


def n_of(text: Column, pattern: str, flags: str = "i") -> Column:
    return F.regexp_count(text, F.lit(jre(pattern, flags)))


def pull(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(text, jre(pattern, flags), group)


def contains_ci(text: Column, word: str) -> Column:
    return F.lower(text).contains(word.lower())


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def unify_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    return F.split(unify_newlines(text), "\n", -1)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def chosen(labels_and_conds: list[tuple[str, Column]]) -> Column:
    """Labels whose condition holds, in list order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for label, c in labels_and_conds]))


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


LANGUAGES = {"cs": "csharp", "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go"}


def detect_language(file_name: Column) -> Column:
    ext = F.regexp_extract(F.lower(file_name), r"\.([^./\\]+)$", 1)
    lookup = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, ext), F.lit("unknown"))


def normalise_text(text: Column, max_len: int | None = 2000) -> Column:
    """Drop NUL, unify line ends, collapse white space, trim, cut to ``max_len`` (None: whole)."""
    t = F.replace(text, F.lit("\x00"), F.lit(""))
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(t) if max_len is None else F.substring(F.trim(t), 1, max_len)
