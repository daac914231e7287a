"""Ground-truth datasets: nested JSON documents in and out.

Documents are read as VARIANT: each text is parsed once, and members are found by name without case in the parsed
value, so no pass over the input infers a schema and documents may differ in spelling. Written datasets are
one document each, under a version that becomes visible by one log entry. A written document has a file or an issue
to a line, and blanks before it say which, so it is read again line by line and never held as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import versions

FILE_FIELDS = {"fileName": "string", "language": "string", "content": "string", "relativePath": "string", "issueCount": "int", "lineCount": "int"}
ISSUE_FIELDS = {
    "id": "string", "fileName": "string", "category": "string", "description": "string", "severity": "string", "location": "string",
    "lineNumber": "int", "codeSnippet": "string", "expectedDetectorAgents": "array<string>", "tags": "array<string>",
    "isMandatory": "boolean", "difficultyLevel": "string",
}
_STATISTIC = {"dimension": "string", "label": "string", "n": "bigint"}
#: Name of a folder whose documents are made of lines, and what such lines begin with (blanks mean nothing in JSON).
_LINES, _HEAD, _FILE, _ISSUE = "lines-", "{", " ", "  "


def _members(v: Column) -> Column:
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _member(members: Column, name: str) -> Column:
    """The value of the first member whose name matches without case."""
    return F.get(F.filter(members, lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def _parsed(text: str) -> Column:
    bad = F.raise_error(F.concat(F.lit("no JSON, or more than a variant holds: "), F.substring(text, 1, 80))).cast("variant")
    return F.coalesce(F.try_parse_json(text), F.when(F.col(text).isNotNull(), bad))


def _build(members: Column, fields: dict[str, str]) -> Column:
    return F.struct(*[F.try_variant_get(_member(members, n), "$", t).alias(n) for n, t in fields.items()])


def _written(spark: SparkSession, path: str) -> str | None:
    """The folder of lines that counts, if the last write made one."""
    folders = versions.live(spark, path)[0]
    return f"{path}/{folders[-1]}" if folders and folders[-1].startswith(_LINES) else None


def _lines(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(dataset_id, value) of the lines of one kind; files are split between tasks anywhere."""
    text = spark.read.schema("value string, dataset string").text(folder, lineSep="\n").where(F.col("value").rlike(rf"^{kind}[,{{]" if kind != _HEAD else r"^\{"))
    ident = F.when(F.col("dataset").startswith("="), F.expr("substring(dataset, 2)"))
    return text.select(ident.alias("dataset_id"), F.expr("substring(value, locate('{', value))").alias("value"))


def _documents(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """One row per document with its members. A file, or a line, holds a document or a list of them."""
    folders = versions.live(spark, path)[0]
    paths = [f"{path}/{folders[-1]}"] if folders else [path]
    text = spark.read.text(paths, wholetext=multi_line, recursiveFileLookup=True).where(F.col("value").rlike(r"\S"))
    docs = text.select(_parsed("value").alias("v"))
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return docs.select(F.explode(many).alias("v")).select(_members(F.col("v")).alias("members"))


def _items(docs: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    items = F.try_variant_get(_member(F.col("members"), name), "$", "array<variant>")
    ident = F.try_variant_get(_member(F.col("members"), "id"), "$", "string")
    return docs.select(ident.alias("dataset_id"), F.inline(F.transform(F.transform(items, _members), lambda x: _build(x, fields))))


def _line_items(spark: SparkSession, folder: str, kind: str, fields: dict[str, str]) -> DataFrame:
    lines = _lines(spark, folder, kind).select("dataset_id", _members(_parsed("value")).alias("members"))
    return lines.select("dataset_id", F.inline(F.array(_build(F.col("members"), fields))))


def read_ground_truth(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Files and issues of every dataset under ``path``; names match without case.

    ``path`` is a folder of documents, one per file (``multi_line``) or per line, or what ``write_ground_truth`` wrote.
    Members that are missing or of another type are null; a text that is no JSON is an error. What was written here is
    read by lines, whatever its documents' size; a document from elsewhere has to fit into a cell.
    """
    folder = _written(spark, path)
    if folder:
        files, issues = _line_items(spark, folder, _FILE, FILE_FIELDS), _line_items(spark, folder, _ISSUE, ISSUE_FIELDS)
    else:
        docs = _documents(spark, path, multi_line)
        files, issues = _items(docs, "files", FILE_FIELDS), _items(docs, "issues", ISSUE_FIELDS)
    issues = issues.fillna(True, ["isMandatory"]).withColumn(
        "expectedDetectorAgents", F.coalesce("expectedDetectorAgents", F.array().cast("array<string>")))
    return files, issues


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, dimension, label, n) from the heads of the documents."""
    folder = _written(spark, path)
    if not folder:
        return _items(_documents(spark, path, True), "statistics", _STATISTIC)
    heads = _lines(spark, folder, _HEAD).select("dataset_id", F.concat("value", F.lit("]}")).alias("value"))  # the open list ends here
    items = F.try_variant_get(_member(_members(_parsed("value")), "statistics"), "$", "array<variant>")
    return heads.select("dataset_id", F.inline(F.transform(F.transform(items, _members), lambda x: _build(x, _STATISTIC))))


def statistics(files: DataFrame, issues: DataFrame) -> DataFrame:
    """(dataset_id, dimension, label, n): issues by severity, category and difficulty, by language from the files, and totals."""
    kinds = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("label")) for d, c in (
        ("severity", F.col("severity")), ("category", F.col("category")), ("difficulty", F.col("difficultyLevel")), ("total issues", F.lit("")))])
    by_issue = issues.select("dataset_id", F.inline(kinds)).groupBy("dataset_id", "dimension", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    kinds = F.array(F.struct(F.lit("language").alias("dimension"), F.coalesce("language", F.lit("")).alias("label"), F.coalesce("issueCount", F.lit(0)).cast("bigint").alias("n")),
                    F.struct(F.lit("total files").alias("dimension"), F.lit("").alias("label"), F.lit(1).cast("bigint").alias("n")))
    by_file = files.select("dataset_id", F.inline(kinds)).groupBy("dataset_id", "dimension", "label").agg(F.sum("n").alias("n"))
    return by_issue.unionByName(by_file)


def write_ground_truth(files: DataFrame, issues: DataFrame, path: str) -> str:
    """Write every dataset as one JSON document with fresh statistics; readers see all of them at once, or none.

    ``files`` and ``issues`` have a ``dataset_id`` and the columns that ``read_ground_truth`` gives; other columns are not
    written. A document is made of lines, one per file or issue, that stream through a task in order, so a
    dataset needs no more memory than its longest line. Datasets are split over tasks, a dataset is not. Blanks before
    a line tell files from issues, so that ``read_ground_truth`` needs no more than a line either.
    """
    def lines(rows: DataFrame, part: int, fields: dict[str, str]) -> DataFrame:
        return rows.select("dataset_id", F.lit(part).alias("part"), F.to_json(F.struct(*fields)).alias("json"))

    heads = statistics(files, issues).groupBy("dataset_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("dimension", "label", "n")))).alias("stats"))
    ident = F.coalesce(F.regexp_extract(F.to_json(F.struct("dataset_id")), r"^\{\"dataset_id\":(.*)\}$", 1), F.lit(""))
    ident = F.when(F.col("dataset_id").isNull(), "null").otherwise(ident)
    heads = heads.select("dataset_id", F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit('{"id":'), ident, F.lit(',"statistics":'), "stats", F.lit(',"files":[')).alias("json")),
        F.struct(F.lit(2).alias("part"), F.lit('],"issues":[').alias("json")), F.struct(F.lit(4).alias("part"), F.lit("]}").alias("json")))))
    every = heads.unionByName(lines(files, 1, FILE_FIELDS)).unionByName(lines(issues, 3, ISSUE_FIELDS))
    first = F.row_number().over(W.partitionBy("dataset_id").orderBy("part", "json"))
    before = F.lag("part").over(W.partitionBy("dataset_id").orderBy("part", "json"))
    comma = F.when(before == F.col("part"), ",").otherwise("")
    blanks = F.when(F.col("part") == 1, _FILE).when(F.col("part") == 3, _ISSUE).otherwise("")
    # a folder's name is never null or empty: Spark would take both for one and sort again, without the place
    name = F.coalesce(F.concat(F.lit("="), "dataset_id"), F.lit("null"))
    out = every.select(name.alias("dataset"), first.alias("place"), F.concat(blanks, comma, "json").alias("value"))
    folder = f"{_LINES}{uuid.uuid4().hex}"
    out.sortWithinPartitions("dataset", "place").select("value", "dataset").write.partitionBy("dataset").text(f"{path}/{folder}")
    versions.commit(files.sparkSession, path, [("add", folder, None)])
    return folder
