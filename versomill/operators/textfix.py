"""Mending books before a run, and looking for words left over after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import epub
from . import leftover, lexicon

#: Languages whose stretched and broken words are mended.
LANGUAGES = ("en",)


def mended(archives: DataFrame, words: DataFrame | None, lang: str) -> DataFrame:
    """archives plus fixes: each document's stretched words with their spelling and pairs of words that a line break parts, as JSON.

    Without a lexicon, or in a language that is not mended, nothing is fixed.
    """
    if words is None or lang not in LANGUAGES:
        return archives.withColumn("fixes", F.lit(None).cast("string"))
    found = epub.suspects(archives).withColumn("word", F.col("a"))
    keys = ("book_id", "doc_index")
    vocabulary = found.where("kind = 'word'").select(*keys, "word")
    spelled = lexicon.unstretched(found.where("kind = 'stretched'"), words, lang, "word", vocabulary, *keys).where("fixed <> word")
    pairs = lexicon.joined_over_break(found.where("kind = 'break'").select(*keys, "a", "b"), words, lang).where("joined")
    by_doc = spelled.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("words"))
    by_doc = by_doc.join(pairs.groupBy(*keys).agg(F.collect_set(F.array("a", "b")).alias("joined")), list(keys), "full")
    by_book = by_doc.groupBy("book_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("doc_index").cast("string").alias("d"), F.struct(F.coalesce("words", F.expr("cast(map() as map<string, string>)")).alias("words"), F.coalesce("joined", F.expr("cast(array() as array<array<string>>)")).alias("joined")).alias("f"))))).alias("fixes"))
    return archives.join(by_book, "book_id", "left")


def checked_archives(translated: DataFrame, engines: list[str], words: DataFrame, src: str, tgt: str, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Translated archives with fewer words left over from the source language, the texts looked at, and the figures.

    ``source`` (text) is the source text, which tells capitalised nouns from names.
    Engines are asked for texts with such words only.
    """
    keys = ("book_id", "entry", "node")
    nodes = epub.text_nodes(translated)
    facts = lexicon.source_facts(source, "text") if source is not None else None
    left = lexicon.leftovers(lexicon.leftover_tokens(nodes, "text", *keys), words, src, tgt, facts)
    fixed = leftover.retranslate(nodes, left, engines, src, tgt, keys)
    changed = fixed.where("fixed <> text").select(*keys, "fixed")
    return epub.with_texts(translated, changed), fixed, leftover.totals(fixed)
