"""Names, glossaries and prompts.

What is learned along a book depends on the order of its answers.  Here that order
is (doc_index, chunk_no, line_no) over the whole run: of equal terms the first wins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import constants as C
from ..functions import text as X


def detect_names(rows: DataFrame, text: str, order: str, limit: int = C.NAMES_MAX, by: str | None = None) -> DataFrame:
    """name and n: words capitalised within sentences at least twice, never seen in lower case; the most frequent, first come first.

    With ``by`` that many names of each group, with the group and their rank.
    """
    group = [by] if by else []
    lower = rows.select(*group, F.explode(F.regexp_extract_all(text, F.lit(r"(\b[a-z][a-z]+\b)"), 1)).alias("word")).distinct()
    sentences = rows.select(*group, order, F.posexplode(X.sentences_for_names(F.col(text))).alias("s_no", "s"))
    words = sentences.select(*group, order, "s_no", F.posexplode(F.regexp_extract_all("s", F.lit(r"([^\s\x{00A0}]+)"), 1)).alias("w_no", "w")).where("w_no > 0")
    words = words.withColumn("name", F.btrim("w", F.lit(C.NAME_EDGES))).where(F.col("name").rlike(C.NAME))
    counts = words.groupBy(*group, "name").agg(F.count("*").alias("n"), F.min(F.struct(order, "s_no", "w_no")).alias("first"))
    counts = counts.where((F.col("n") >= 2) & ~F.col("name").isin(C.COMMON_CAPITALS)).withColumn("word", F.lower("name"))
    counts = counts.join(lower, [*group, "word"], "left_anti")
    if by is None:
        return counts.orderBy(F.desc("n"), "first").limit(limit).select("name", "n")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit).select(by, "rank", "name", "n")


def accepted(answers: DataFrame, chunk_text: str, answer: str, *order: str) -> DataFrame:
    """term and target of all acceptable lines of the answers' glossary blocks, the first of each term."""
    lines = answers.select(*order, F.col(chunk_text).alias("chunk"), F.posexplode(X.glossary_lines(F.col(answer))).alias("line_no", "x"))
    lines = lines.select(*order, "line_no", "chunk", "x.term", "x.target")
    ok = (F.col("term") != "") & (F.col("target") != "") & (F.length("term") < C.TERM_MAX) & (F.length("target") < C.TARGET_MAX) & F.contains(F.lower("chunk"), F.lower("term"))
    return first_wins(lines.where(ok), "term", "target", *order, "line_no")


def first_wins(rows: DataFrame, key: str | list[str], value: str, *order: str) -> DataFrame:
    return rows.groupBy(*([key] if isinstance(key, str) else key)).agg(F.min_by(value, F.struct(*order)).alias(value))


def whole_text(rows: DataFrame, group: str, text: str, *order: str) -> DataFrame:
    """group and text: all texts of a group in order, with spaces between; a group is a book, which fits into a row."""
    every = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(every, lambda x: x["t"]), " ").alias("text"))


def merged(user: DataFrame, learned: DataFrame) -> DataFrame:
    """Both glossaries; where both have a term the user's target stays."""
    u, k = user.select("term", F.col("target").alias("own")), learned.select("term", F.col("target").alias("other"))
    return u.join(k, "term", "full").select("term", F.coalesce("own", "other").alias("target"))


#: Terms in one automaton; more go through the texts in blocks.
TERMS_AT_ONCE = 200_000


def in_text(terms: DataFrame, texts: DataFrame, term: str, text: str) -> DataFrame:
    """texts with each term that they contain, wherever it begins; one row a pair.

    One automaton over all terms of a block reads each text once, whatever the number
    of terms.  Glossaries are small beside the texts; a block is bounded, and its terms
    are broadcast.
    """
    context = texts.sparkSession.sparkContext
    known = terms.select(F.col(term).alias("t")).where("t is not null and t <> ''").distinct().withColumn("block", F.pmod(F.xxhash64("t"), F.lit(max(1, -(-terms.count() // TERMS_AT_ONCE)))))
    blocks = sorted(r["block"] for r in known.select("block").distinct().collect())
    schema = StructType([*texts.schema.fields, StructField(term, StringType())])
    at = texts.columns.index(text)
    out = texts.withColumn(term, F.lit(None).cast("string")).where(F.lit(False))
    for block in blocks:
        words = context.broadcast(sorted(r["t"] for r in known.where(F.col("block") == block).collect()))  # TERMS_AT_ONCE of them, about

        def run(batches, words=words):
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in words.value:
                a.add_word(w, w)
            a.make_automaton()
            for b in batches:
                rows, found = [], []
                for k, x in enumerate(b.column(at).to_pylist()):
                    for w in sorted({w for _, w in a.iter(x)}) if x else ():
                        rows.append(k)
                        found.append(w)
                kept = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], [*b.schema.names, term])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def for_book(learned: DataFrame, user: DataFrame, book: DataFrame, text: str) -> DataFrame:
    """Learned terms that the user gave or that occur in the book, whatever the case."""
    low = learned.select(F.lower("term").alias("__term"))
    found = in_text(low, book.select(F.lower(text).alias("__text")), "__term", "__text").select("__term").distinct()
    given = user.select(F.lower("term").alias("__term"), F.col("term").alias("__own"))
    hits = learned.join(found, F.lower("term") == F.col("__term"), "left_semi")
    own = learned.join(given, F.col("term") == F.col("__own"), "left_semi")
    return hits.unionByName(own).distinct()


def for_books(learned: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, term and target of what was learned for a book (book, term, target) and stands in its text (book_id, text), whatever the case."""
    low = learned.select(F.col("book").alias("book_id"), "term", "target", F.lower("term").alias("low"))
    found = in_text(low.select("low").distinct(), books.select("book_id", F.lower("text").alias("body")), "low", "body").select("book_id", "low").distinct()
    return low.join(found, ["book_id", "low"], "left_semi").select("book_id", "term", "target")


def for_prompt(glossary: Column, chunk: Column) -> Column:
    """Entries of a map that a chunk's prompt gets: all of a short glossary, else those whose term is in the chunk."""
    return F.when(F.size(glossary) <= C.PROMPT_GLOSSARY_MAX, glossary).otherwise(F.map_filter(glossary, lambda k, v: F.contains(chunk, k)))


def name_hints(names: Column, glossary: Column, chunk: Column) -> Column:
    return F.filter(names, lambda n: F.contains(chunk, n) & ~F.map_contains_key(glossary, n))


def glossary_part(glossary: Column, hints: Column) -> Column:
    lines = F.transform(F.map_entries(glossary), lambda e: F.concat(e["key"], F.lit(" => "), e["value"]))
    known = F.when(F.size(lines) > 0, F.concat(F.lit("Glossary (use these translations):\n"), F.array_join(lines, "\n"), F.lit("\n\n")))
    names = F.when(F.size(hints) > 0, F.concat(F.lit("Names: "), F.array_join(hints, ", "), F.lit("\n\n")))
    return F.concat_ws("", known, names)


def context_part(sources: Column, targets: Column) -> Column:
    pairs = F.zip_with(sources, targets, lambda a, b: F.concat(a, F.lit(" => "), b))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("Context (do not translate):\n"), F.array_join(pairs, "\n"), F.lit("\n\n"))).otherwise("")


def frames(ids: Column, texts: Column) -> Column:
    return F.array_join(F.zip_with(ids, texts, lambda i, t: F.concat(F.lit('<seg id="'), i.cast("string"), F.lit('">'), t, F.lit("</seg>"))), "\n")


def user_prompt(glossary: Column, hints: Column, sources: Column, targets: Column, src: Column, tgt: Column, ids: Column, texts: Column) -> Column:
    ask = F.concat(F.lit("Translate the following segments from "), X.language_name(src), F.lit(" into "), X.language_name(tgt), F.lit(".\n\n"))
    return F.concat(glossary_part(glossary, hints), context_part(sources, targets), ask, frames(ids, texts))


def system_prompt(src: Column, tgt: Column, dialogue: Column) -> Column:
    """Our own wording; rules for Turkish have a dialogue style, unknown styles count as quotes."""
    style = F.when(dialogue == "dash", "Begin each speech with a dash.").otherwise("Put speech in quotation marks.")
    rules = F.when(F.startswith(F.lower(tgt), F.lit("tr")), F.concat(F.lit("Write fluent, literary Turkish. "), style)).otherwise(F.concat(F.lit("Write fluent, literary "), X.language_name(tgt), F.lit(".")))
    return F.concat(F.lit("You translate books from "), X.language_name(src), F.lit(" into "), X.language_name(tgt), F.lit(". "), rules, F.lit("\nReturn every segment with its id and keep all placeholders."))


def answers_by_id(requests: DataFrame, answers: DataFrame, *chunk: str) -> DataFrame:
    """requests (chunk, local_id) with the answers' texts: of an id that comes twice the last; unknown ids are ignored, empty texts are missing."""
    found = answers.select(*chunk, F.posexplode(X.segment_frames(F.col("answer"))).alias("pos", "x")).select(*chunk, "pos", F.col("x.id").alias("local_id"), "x.text")
    last = found.groupBy(*chunk, "local_id").agg(F.max_by("text", "pos").alias("text"))
    return requests.join(last, [*chunk, "local_id"], "left").withColumn("text", F.nullif("text", F.lit("")))
