"""Books from archive to archive: the front door to a run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import epub
from . import cache as K
from . import engines as E
from . import quality, report, segments, story, textfix, toc, translate


def selected(segs: DataFrame, chapters: str | None = None, limit: int = 0) -> DataFrame:
    """Segments of the chosen chapters (places of content documents) with navigation and labels, then the first ``limit`` in order."""
    if chapters:
        content = segs.where("doc_index >= 0 and kind <> 'toc'")
        rest = segs.where("doc_index < 0 or kind = 'toc'")
        segs = segments.chapters(content, "doc_index", chapters).select(*segs.columns).unionByName(rest)
    return segments.prefix_limit(segs, limit, "book_id", "doc_index", "seg_no")


def inspect(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segments, headings and characters of every document of the books."""
    found = epub.segments(epub.read(spark, paths))
    return found.groupBy("book_id", "doc_index").agg(F.count("*").alias("n_segments"), F.count_if(F.col("kind") == "heading").alias("n_headings"), F.sum(F.length("source")).alias("n_chars"))


def _fixed(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """What the engines gave is kept: written below ``folder``, or, without one, held by Spark."""
    if folder is None:
        return df.persist()
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def translate_books(
    spark: SparkSession,
    paths: str | list[str],
    engines: list[str],
    src: str,
    tgt: str,
    cache: DataFrame | None = None,
    chapters: str | None = None,
    limit: int = 0,
    bilingual: bool = False,
    pause: bool = True,
    user_glossary: DataFrame | None = None,
    glossary: DataFrame | None = None,
    polish: bool = False,
    polish_engine: str | None = None,
    dialogue: str = "quotes",
    context: int = 3,
    lexicon: DataFrame | None = None,
    better: bool = False,
    check: bool = False,
    strip_boilerplate: bool = False,
    model: str | None = None,
    folder: str | None = None,
) -> dict:
    """Tables of one run: archives, segments, cache (new rows), glossary, calls, summary, and report, a dict of figures.

    ``lexicon`` (lang, word, zipf) mends words before the run; ``better`` adds a quality
    pass and ``check`` one for words left over, which needs a lexicon.  ``glossary`` is
    what earlier runs learned.  ``folder`` is one that the executors share: with it every
    engine is asked once, whatever executors are lost.  Batches do not cross books.
    """
    began = time.monotonic()
    archives = textfix.mended(epub.read(spark, paths, tgt), lexicon, src)
    segs = selected(epub.segments(archives, strip_boilerplate=strip_boilerplate), chapters, limit)
    rows = segs.select("book_id", F.col("doc_index").cast("long").alias("doc_index"), F.col("seg_no").cast("long").alias("seg_no"), "uid", "kind", "source", "plain")
    rows = _fixed(rows, folder, "segments")
    primary = E.make(engines[0], src, tgt)
    learned, polished = glossary, 0
    if primary.is_llm and primary.complete is not None:
        settings = story.Settings(src, tgt, dialogue, context=context, polish=polish, polish_engine=polish_engine, pause=pause)
        found = _fixed(story.translate(rows, story.book_facts(rows, user_glossary, glossary), engines, cache, settings, model), folder, "results")
        calls, learned = story.calls(found), story.glossary_rows(found, glossary)
        polished = story.facts(found).agg(F.coalesce(F.sum("f.polished"), F.lit(0)).alias("n")).collect()[0]["n"]
        done = rows.join(found.select("book_id", "doc_index", "seg_no", "translation", "engine", "hit"), ["book_id", "doc_index", "seg_no"], "left")
    else:
        through = F.xxhash64("book_id", "doc_index")
        numbered = rows.withColumn("own_index", F.col("doc_index")).withColumn("doc_index", through)
        done, _, calls = translate.translate(numbered, engines, cache, src, tgt, model, polish, pause=pause)
        done = done.withColumn("doc_index", F.col("own_index")).drop("own_index")
    done = _fixed(done.withColumn("hit", F.coalesce("hit", F.lit(False))), folder, "translations")
    fresh = translate.cache_rows(done, engines, src, tgt, model, polish)
    translators = [n for n in engines if not E.make(n, src, tgt).is_llm]
    stats = None
    if better and translators:
        keyed = done.withColumn("own_uid", F.col("uid")).withColumn("uid", F.concat_ws("\x1f", "book_id", "uid"))
        improved, log, stats = quality.improve(keyed, translators, translators[0], src, tgt, lexicon)
        improved, log = _fixed(improved, folder, "improved"), _fixed(log, folder, "changes")
        if not primary.is_llm:
            fresh = K.upsert(fresh, quality.cache_update(log, improved, primary.name, src, tgt), "key")
        done = improved.withColumn("uid", F.col("own_uid")).drop("own_uid")
    labels, others = done.where("kind = 'toc'"), done.where("kind <> 'toc'")
    heads = others.where("kind = 'heading'")
    done = others.unionByName(toc.harmonised(labels, heads, "doc_index", "seg_no"))
    titles = toc.title(epub.books(archives).select("book_id", "title"), done, bilingual)
    made = _fixed(epub.rewrite_all(archives, done, tgt, titles, bilingual, strip_boilerplate), folder, "archives")
    qa = None
    if check and lexicon is not None and not bilingual:
        made, texts, qa = textfix.checked_archives(made, translators or engines, lexicon, src, tgt, rows.select(F.col("plain").alias("text")))
        made = _fixed(made, folder, "checked")
    models = {n: (model if n == engines[0] and model else E.make(n, src, tgt).model) or "" for n in engines}
    return {
        "archives": made,
        "segments": done,
        "cache": fresh.select(*[f.split()[0] for f in K.SCHEMA.split(", ")]),
        "glossary": learned,
        "calls": calls,
        "summary": report.summary(done),
        "report": report.run_report(done, calls, made, learned, models, time.monotonic() - began, polished, stats, qa),
    }
