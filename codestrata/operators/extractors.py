"""Extractors of one's own: a language added at run time, whose rows the built-in measures read like any others.

An extractor is a function of one text that yields declarations, or a function of the files' table that
returns a table of symbols. Either way its columns are checked against ``SYMBOLS`` before they meet the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import detect_language
from .blocks import SYMBOLS, block_symbols

_SCHEMA = T.StructType([T.StructField(n, {"string": T.StringType(), "int": T.IntegerType()}[t]) for n, t in (f.split() for f in SYMBOLS.split(", "))])
_NEEDED = ("kind", "name", "line")
KINDS = {"class", "interface", "struct", "record", "enum", "method", "constructor", "property", "field", "event"}


def checked(symbols: DataFrame) -> DataFrame:
    """``symbols`` in the order and types of ``SYMBOLS``; columns that may be absent are filled, a wrong table is an error."""
    missing = [c for c in ("file_name", "language", *_NEEDED) if c not in symbols.columns]
    if missing:
        raise ValueError(f"an extractor's table lacks {', '.join(missing)}")
    for f in _SCHEMA:
        if f.name in symbols.columns:
            got = symbols.schema[f.name].dataType
            same = isinstance(got, T.IntegralType) if isinstance(f.dataType, T.IntegerType) else isinstance(got, (T.StringType, T.NullType))
            if not same:
                raise ValueError(f"column {f.name} of an extractor is {got.simpleString()}, not {f.dataType.simpleString()}")
    absent = {"owner": F.lit(None), "end_line": F.col("line")}
    cols = [(F.col(f.name) if f.name in symbols.columns else absent.get(f.name, F.lit(""))).cast(f.dataType).alias(f.name) for f in _SCHEMA]
    return symbols.select(*cols)


def per_text(extract: Callable[[str], Iterable[dict]]) -> Callable[[DataFrame], DataFrame]:
    """An extractor of tables from a function of one text that yields dicts: kind, name and line, other columns at will."""
    names = [f.name for f in _SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_SCHEMA)
        for b in batches:
            rows = []
            for name, language, text in zip(*[(x.as_py() for x in b.column(i)) for i in range(3)]):
                for d in extract(text or ""):
                    unknown = set(d) - set(names)
                    if unknown or not all(d.get(k) for k in _NEEDED) or d["kind"] not in KINDS:
                        raise ValueError(f"an extractor gave {d!r}")
                    row = {"owner": None, "end_line": d["line"], "mods": "", "rtype": "", "params": "", "bases": ""} | d | {"file_name": name, "language": language}
                    rows.append([row[c] for c in names])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(names))], names)

    return lambda files: files.select("file_name", "language", "content").mapInArrow(run, SYMBOLS)


class Extractors:
    """The languages that are read, each by its extractor; those not named are read by blocks."""

    def __init__(self, builtin: Callable[[DataFrame], DataFrame] = block_symbols) -> None:
        self._builtin, self._own, self._extensions = builtin, {}, {}

    def add(self, language: str, extract: Callable[[DataFrame], DataFrame], extensions: Iterable[str] = ()) -> Extractors:
        """Read ``language`` with ``extract``; files with these extensions are in that language."""
        self._own[language] = extract
        self._extensions |= {e.lower().lstrip("."): language for e in extensions}
        return self

    def with_language(self, files: DataFrame) -> DataFrame:
        """``files`` with the language that the extension says, own extensions first."""
        ext = F.regexp_extract(F.lower("file_name"), r"\.([^./\\]+)$", 1)
        language = detect_language(F.col("file_name"))
        for e, own in self._extensions.items():
            language = F.when(ext == e, own).otherwise(language)
        return files.withColumn("language", language)

    def symbols(self, files: DataFrame) -> DataFrame:
        """The symbols of all ``files``, a union of what the extractors give; every file goes to one of them."""
        own = list(self._own)
        out = checked(self._builtin(files.where(~F.col("language").isin(own)) if own else files))
        for language, extract in self._own.items():
            out = out.unionByName(checked(extract(files.where(F.col("language") == language))))
        return out
