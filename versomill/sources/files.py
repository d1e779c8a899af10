"""Text sources: glossaries, dumps of runs, event streams, validator reports, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def glossary_from_lines(lines: DataFrame) -> DataFrame:
    """term and target from (line_no, value): cut at the first of =>, tab and = that a line has; of equal terms the last."""
    v = F.trim("value")
    sep = F.when(v.contains("=>"), "=>").when(v.contains("\t"), "\t").when(v.contains("="), "=")
    rows = lines.where((v != "") & ~F.startswith(v, F.lit("#"))).select("line_no", v.alias("v"), sep.alias("sep")).where("sep is not null")
    rows = rows.select("line_no", F.trim(F.expr("substring(v, 1, instr(v, sep) - 1)")).alias("term"), F.trim(F.expr("substring(v, instr(v, sep) + length(sep))")).alias("target"))
    return rows.where("term <> '' and target <> ''").groupBy("term").agg(F.max_by("target", "line_no").alias("target"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object, or lines."""
    whole = spark.read.text(path, wholetext=True)
    text = X.strip(F.col("value"))
    as_json = F.from_json(text, "map<string, string>")
    found = whole.select(as_json.alias("m"), text.alias("t")).where(F.startswith("t", F.lit("{"))).select(F.explode("m").alias("term", "target"))
    lines = whole.where(~F.startswith(text, F.lit("{"))).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return found.unionByName(glossary_from_lines(lines))


def dumps(spark: SparkSession, glob: str) -> DataFrame:
    """run (the file's stem), uid, source, translation and engine of all JSON-lines dumps."""
    rows = spark.read.schema("uid string, source string, translation string, engine string").json(glob)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("run"), "uid", "source", "translation", "engine")


def event_text(stream: Column) -> Column:
    """The text of a stream of JSON events in lines; of a stream that has none, its plain lines without colours."""
    schema = "type string, part struct<text: string>, error string"
    lines = F.filter(F.split(stream, r"\r?\n"), lambda x: F.startswith(F.ltrim(x), F.lit("{")))
    events = F.filter(F.transform(lines, lambda x: F.from_json(x, schema)), lambda e: e["type"].isNotNull())
    texts = F.transform(F.filter(events, lambda e: (e["type"] == "text") & e["part"]["text"].isNotNull()), lambda e: e["part"]["text"])
    return F.when(F.size(events) > 0, F.array_join(texts, "")).otherwise(F.trim(X.strip_ansi(stream)))


def event_errors(stream: Column) -> Column:
    """The first 500 characters of every error event."""
    lines = F.filter(F.split(stream, r"\r?\n"), lambda x: F.get_json_object(x, "$.type") == "error")
    return F.transform(lines, lambda x: F.substring(F.get_json_object(x, "$.error"), 1, 500))


def validator_errors(reports: DataFrame, column: str = "value") -> DataFrame:
    """``ID message`` of every error and fatal message of reports in JSON, sorted."""
    schema = "messages array<struct<ID: string, severity: string, message: string>>"
    rows = reports.select(F.explode(F.from_json(column, schema)["messages"]).alias("m"))
    return rows.where(F.col("m.severity").isin("ERROR", "FATAL")).select(F.concat_ws(" ", "m.ID", "m.message").alias("error")).orderBy("error")


def markdown_headings(files: DataFrame) -> DataFrame:
    """file, pos and heading of (file, text); fenced code is left out."""
    text = F.regexp_replace("text", r"(?s)```.*?```", "")
    return files.select("file", F.posexplode(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), 1)).alias("pos", "heading"))


def markdown_links(files: DataFrame) -> DataFrame:
    """file, pos, path and anchor of every link of (file, text)."""
    found = files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("pos", "url"))
    return found.select("file", "pos", "url", F.split("url", "#", 2)[0].alias("path"), F.get(F.split("url", "#", 2), F.lit(1)).alias("anchor"))


def changelog_section(text: Column, version: str) -> Column:
    return X.strip(F.regexp_extract(text, r"(?sm)^##\s*\[?" + version.replace(".", r"\.") + r"\]?[^\n]*\n(.*?)(?=^##\s|\z)", 1))
