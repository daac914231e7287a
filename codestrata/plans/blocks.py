"""Declarations by blocks and extractors of one's own. The SQL sides hold rows that were counted by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data.samples import DECLARED, SAMPLES, chapters
from ..data.snippets import EXTENSIONS
from ..functions.text import LANGUAGES
from ..operators import graph as G, symbols as SY
from ..operators.blocks import block_symbols
from ..operators.extractors import Extractors, per_text
from ..sources import views as V
from .oracle import VIEWS, lit, pick, q
from .registry import register

TYPES = ["class", "interface", "struct", "record", "enum"]


def _sql(x) -> str:
    return "NULL" if x is None else lit(x) if isinstance(x, str) else str(x)


_rows = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in DECLARED)
VIEWS["v_counted"] = f"SELECT * FROM (VALUES {_rows}) t(ext, kind, name, owner, line, end_line)"
_language = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in LANGUAGES.items()) + " ELSE 'unknown' END"
VIEWS["v_nested"] = f"SELECT doc_id, ext, 'app/Nested/U' || doc_id || '.' || ext AS file_name, {_language} AS language, text FROM (SELECT *, {pick(EXTENSIONS, 'doc_id % 7')} AS ext FROM documents)"
VIEWS["v_blocks"] = "SELECT file_name, language, kind, name, coalesce(owner, '') AS owner, line, end_line FROM v_nested JOIN v_counted USING (ext)"


def _of(types: bool):
    def rows(s, d):
        is_type = F.col("kind").isin(TYPES)
        return block_symbols(V.nested_files(s, d)).where(is_type if types else ~is_type).select(
            "file_name", "language", "kind", "name", F.coalesce("owner", F.lit("")).alias("owner"), "line", "end_line")

    return rows


_in = ", ".join(map(lit, TYPES))
register("block_classes", _of(True), q(f"SELECT * FROM v_blocks WHERE kind IN ({_in})"))
register("block_functions", _of(False), q(f"SELECT * FROM v_blocks WHERE kind NOT IN ({_in})"))


def _custom(s, d):
    languages = Extractors().add("chapters", per_text(chapters), ["txt"])
    files = languages.with_language(V.nested_files(s, d))
    symbols = languages.symbols(files)
    nodes = G.dep_nodes(G.declared(symbols, files)).groupBy("file_name").agg(F.count("*").alias("nodes"))
    counts = SY.file_counts(files, symbols=symbols).select("file_name", "language", "classes", "methods", "properties")
    return counts.join(nodes, "file_name", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))


VIEWS["v_chapter_lines"] = f"""
SELECT file_name, line, first, small, last_value(CASE WHEN first <> '' THEN first END IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line) AS owner FROM (
SELECT file_name, line, regexp_extract(x, '^[A-Z][a-z]+') AS first, regexp_extract(x, '^[a-z]+') AS small FROM (
SELECT file_name, unnest(string_split({lit(SAMPLES['txt'])} || chr(10) || text, chr(10))) AS x, generate_subscripts(string_split({lit(SAMPLES['txt'])} || chr(10) || text, chr(10)), 1) AS line
FROM v_nested WHERE ext = 'txt'))"""
VIEWS["v_all_symbols"] = """
SELECT file_name, CASE WHEN kind IN ('class', 'struct', 'record') THEN 'class' ELSE kind END AS kind, owner, name FROM v_nested JOIN v_counted USING (ext)
UNION ALL SELECT file_name, CASE WHEN first <> '' THEN 'class' ELSE 'method' END, CASE WHEN first <> '' THEN NULL ELSE owner END, CASE WHEN first <> '' THEN first ELSE small END
FROM v_chapter_lines WHERE first <> '' OR small <> ''"""
register("custom_extractor", _custom, q("""
SELECT n.file_name, CASE WHEN ext = 'txt' THEN 'chapters' ELSE language END AS language, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'method') AS methods,
  count(*) FILTER (kind = 'property') AS properties,
  count(DISTINCT CASE WHEN kind = 'class' THEN concat_ws('.', owner, name) WHEN owner IS NOT NULL AND kind IN ('method', 'property') THEN owner || '::' || name END) AS nodes
FROM v_nested n LEFT JOIN v_all_symbols s ON n.file_name = s.file_name GROUP BY ALL"""))
