"""Sinks: dumps, summaries and archives."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dump_rows(segments: DataFrame, *order: str) -> DataFrame:
    """One JSON object a segment, in document order."""
    return segments.orderBy(*order).select(F.to_json(F.struct("uid", "source", "translation", "engine"), {"ignoreNullFields": "false"}).alias("value"))


def write_dump(segments: DataFrame, path: str, *order: str) -> None:
    """Files of JSON lines whose names sort as the documents do."""
    dump_rows(segments, *order).write.mode("overwrite").text(path)


def summary_json(summary: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """The summary as one JSON object, with the glossary if given: a book's, which is small."""
    if glossary is not None:
        terms = glossary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "target")))).alias("glossary"))
        # one row each
        summary = summary.withColumn("__k", F.lit(1)).join(terms.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return summary.select(F.to_json(F.struct("*")).alias("value"))


def write_archives(rewritten: DataFrame, folder: str) -> list[str]:
    """Writes each archive to a local folder, one at a time; for a store, write the table itself."""
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for r in rewritten.select("name", "content").toLocalIterator():
        path = Path(folder) / r["name"]
        path.write_bytes(bytes(r["content"]))
        out.append(str(path))
    return out
