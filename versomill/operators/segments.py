"""Selecting and summing up segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X


def inspect(segments: DataFrame) -> DataFrame:
    """Segments, headings and characters of every document."""
    return segments.groupBy("doc_index").agg(
        F.count("*").alias("n_segments"),
        F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).cast("bigint").alias("n_headings"),
        F.sum(F.length("source")).cast("bigint").alias("n_chars"),
    )


def kind_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("kind").agg(F.count("*").alias("n"))


def totals(docs: DataFrame, by: str) -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("n_segments"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def prefix_limit(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order over all documents; 0 means all."""
    return rows.orderBy(*order).limit(n) if n else rows


def chapters(rows: DataFrame, doc: str, wanted: str) -> DataFrame:
    """Rows of the documents whose place among all (from 1) is in ``wanted``, such as 1-3,5.

    Places are counted up to the last one wanted only: the smallest ids are found by a
    bounded sort in each partition, so no task has all of them.
    """
    last = max((int(x) for part in wanted.split(",") for x in part.split("-") if x.strip()), default=0)
    first = rows.select(doc).distinct().orderBy(doc).limit(last)
    place = first.withColumn("__place", F.row_number().over(Window.orderBy(doc)))
    picked = place.where(F.array_contains(X.ranges(F.lit(wanted)), F.col("__place"))).select(doc)
    return rows.join(picked, doc, "left_semi")


def translatable(plain: Column) -> Column:
    return X.has_letter(plain)


def marked_untranslatable(translate: Column, classes: Column) -> Column:
    return (F.lower(translate) == "no") | F.array_contains(F.split(classes, r"\s+"), "notranslate")


def boilerplate(element_id: Column, classes: Column) -> Column:
    return element_id.isin(C.BOILERPLATE_IDS) | classes.contains(C.BOILERPLATE_CLASS)


def missing_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, rows without translation and the exit code: 0, or 2 if any is missing."""
    missing = F.count_if(X.untranslated(F.col("translation")))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), missing.alias("missing"), F.when(missing == 0, 0).otherwise(2).alias("exit_code"))
