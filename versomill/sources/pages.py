"""Pages as documents, and their segments, by regular expressions that every engine shares.

A segment is the text of a p, h1-h6 or li element, cut at the nearest closing tag.
Scripts, styles, heads and comments are left out first.  Segments are numbered
within their page before those without a letter are dropped, so gaps are normal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

DROPPED = r"(?is)<script.*?</script>|<style.*?</style>|<head.*?</head>"
COMMENT = r"(?s)<!--.*?-->"
BLOCK = r"(?s)(<p(?:\s[^>]*)?>.*?</p>|<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>|<li(?:\s[^>]*)?>.*?</li>)"
NAV = r"(?s)<nav(?:\s[^>]*)?>.*?</nav>"


def documents(pages: DataFrame) -> DataFrame:
    """doc_index, url and markup without what is never text."""
    markup = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), DROPPED, ""), COMMENT, "")
    return pages.select(F.col("page_id").alias("doc_index"), "url", markup.alias("markup"))


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each block element: doc_index, seg_no from 1 and raw markup."""
    found = docs.select("doc_index", F.posexplode(F.regexp_extract_all("markup", F.lit(BLOCK), 1)).alias("pos", "raw"))
    return found.select("doc_index", (F.col("pos") + 1).alias("seg_no"), "raw")


def segments(pages: DataFrame) -> DataFrame:
    """doc_index, seg_no, uid, kind, source and plain of all translatable blocks."""
    found = blocks(documents(pages))
    source = X.collapse_simple(X.strip_tags(F.col("raw"), ""))
    found = found.select(
        "doc_index",
        "seg_no",
        F.concat_ws(":", "doc_index", "seg_no").alias("uid"),
        F.when(F.col("raw").rlike("^<h[1-6]"), "heading").otherwise("text").alias("kind"),
        source.alias("source"),
    )
    return found.withColumn("plain", X.unescape_known(F.col("source"))).where(X.has_letter(F.col("plain")))


def nav_labels(pages: DataFrame) -> DataFrame:
    """Labels of links inside nav elements: doc_index, pos and label."""
    nav = F.array_join(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(f"({NAV})"), 1), " ")
    found = pages.select(F.col("page_id").alias("doc_index"), F.posexplode(F.regexp_extract_all(nav, F.lit(r"(?s)(<a(?:\s[^>]*)?>.*?</a>)"), 1)).alias("pos", "raw"))
    label = X.unescape_known(X.collapse_simple(X.strip_tags(F.col("raw"), "")))
    return found.select("doc_index", (F.col("pos") + 1).alias("pos"), label.alias("label")).where(X.has_letter(F.col("label")))
