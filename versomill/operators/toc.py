"""Contents labels in line with headings, and the title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X


def harmonised(labels: DataFrame, headings: DataFrame, *keys: str) -> DataFrame:
    """labels (source, plain, translation) with the translation of the first heading of the same text.

    A label that is one outer element keeps it; other labels with markup stay as they are.
    """
    norm = F.lower(F.trim("plain"))
    first = headings.where(F.col("translation").isNotNull() & (F.col("translation") != "")).groupBy(norm.alias("__norm")).agg(F.min_by("translation", F.struct(*keys)).alias("__heading"))
    joined = labels.join(first, norm == F.col("__norm"), "left")
    bare = F.regexp_replace("__heading", r"</?g\d+>|<x\d+/>", "")
    number, inner = F.regexp_extract("source", C.OUTER_ELEMENT, 1), F.regexp_extract("source", C.OUTER_ELEMENT, 2)
    single = F.col("source").rlike(C.OUTER_ELEMENT) & ~inner.contains("<")
    tagged = X.has_markup(F.col("source"))
    new = F.when(F.col("__heading").isNull(), F.col("translation")).when(single, F.concat(F.lit("<g"), number, F.lit(">"), bare, F.lit("</g"), number, F.lit(">"))).when(~tagged, bare).otherwise(F.col("translation"))
    return joined.withColumn("translation", new).drop("__norm", "__heading")


def title(books: DataFrame, segments: DataFrame, bilingual: bool = False) -> DataFrame:
    """book_id and new_title: the translation of the first heading that is the title."""
    heads = segments.where((F.col("kind") == "heading") & F.col("translation").isNotNull() & (F.col("translation") != ""))
    b = books.select("book_id", "title", F.lower(F.trim("title")).alias("__t"))
    found = b.join(heads.withColumn("__t", F.lower(F.trim("plain"))), ["book_id", "__t"])
    best = found.groupBy("book_id", "title").agg(F.min_by("translation", F.struct("doc_index", "seg_no")).alias("t"))
    bare = F.trim(F.regexp_replace("t", r"</?g\d+>|<x\d+/>", ""))
    return best.select("book_id", F.when(F.lit(bilingual), F.concat_ws(" / ", "title", bare)).otherwise(bare).alias("new_title"))
