"""Benchmark decontamination: windows of training words against a hash set of test n-grams.

Every window of ``n`` words of a test item, or the whole item where it has fewer,
goes by its hash into a set of plain 64-bit numbers that is broadcast; its size is
checked before, and a larger set meets the windows' hashes by a shuffle.  A document's
windows are scanned within its row; those without the longest word of any test window
cannot be one and are not hashed.  A window whose hash is in the set is compared word by
word.  Windows carry their own few words and a number of their row; only hits and one
short row for each document are grouped by document, and texts are never shuffled
unless very many documents have hits that are to be cut out.

Null and empty texts have no words and are never hit.  Items without an id or
without words are left out; items with equal ids count once.  Documents are judged
row by row, so repeated rows and ids, or none, do not matter.  Texts of any length are
scanned whole.  ``cleaned`` keeps all other columns, whatever their names and types.
Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names, text_keys, written
from .native import BREAK, WORD, word_array

#: Hashes that are broadcast at most: at some 40 bytes each, about 40 MB.
MOST_WINDOWS = 1_000_000
#: Words that a window must have one of, at most; they are part of the plan.
MOST_ANCHORS = 20_000
#: Stands for the document itself among the hashes of its windows.
_SELF = -6148914691236517205


def item_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """hash, words, k (their number) and the items that have this window; one row a window."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("w"))
    rows = rows.where(F.col("item").isNotNull() & (F.size("w") > 0))
    rows = rows.withColumn("k", F.least(F.size("w"), F.lit(n)))
    rows = rows.select("item", "k", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    rows = rows.select("item", "k", F.slice("w", F.col("i"), F.col("k")).alias("words"))
    rows = rows.groupBy("words", "k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select(F.xxhash64("words").alias("hash"), "words", "k", "items")


def _coverage(hits: Column) -> Column:
    """Words in the union of hits, which are (start, number of words, items)."""
    start = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("total"))

    def add(acc, h):
        end = h["at"] + h["k"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], h["at"]))).alias("total"))

    return F.aggregate(F.array_sort(hits), start, add, lambda acc: acc["total"])


def _anchors(windows: DataFrame, most: int) -> list[str] | None:
    """Words of which every window has one: its longest, as long words are rare ones; None if they are too many."""
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    found = [r["w"] for r in windows.select(longest.alias("w")).distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def _candidates(k: int) -> Column:
    """(first word, length, words) of the windows of k words of ``words`` that hold one of the places ``near``; there are ``n`` words."""
    starts = F.transform("near", lambda p: F.sequence(F.greatest(F.lit(1), p - k + 1), F.least(p, F.col("n") - k + 1)))
    each = F.transform(F.array_distinct(F.flatten(starts)), lambda i: F.struct((i - 1).alias("at"), F.lit(k).alias("k"), F.slice("words", i, k).alias("own")))
    return F.when(F.col("n") >= k, each).otherwise(F.expr("cast(array() as array<struct<at: int, k: int, own: array<string>>>)"))


def find_hits(rows: DataFrame, text: str, benchmark: DataFrame, n: int = 13, most_windows: int = MOST_WINDOWS, most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """Every row's other columns with n_words and hits: (first word, number of words, items), words from 0.

    ``rows`` has plain column names, none of them one of those used here.
    """
    windows = item_windows(benchmark, n)
    sizes = {r["k"]: r["n"] for r in windows.groupBy("k").agg(F.count("*").alias("n")).collect()}  # n rows at most
    anchors = _anchors(windows, most_anchors)

    others = [c for c in rows.columns if c != text]
    words = word_array(F.col(text))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.struct(*others).alias("doc"), words.alias("words"))
    none = F.expr("cast(array() as array<int>)")
    if anchors is None:
        near = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"))).otherwise(none)
    else:
        place = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), i + 1)), lambda i: i.isNotNull())
        near = F.when(F.arrays_overlap("words", F.array(*map(F.lit, anchors)).cast("array<string>")), place).otherwise(none)
    rows = rows.select("row", "doc", "words", F.size("words").alias("n"), near.alias("near"))
    # the document itself comes first, as a window without words
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("k"), F.lit(None).cast("array<string>").alias("own")))
    rows = rows.select("row", "doc", "n", F.inline(F.concat(itself, *[_candidates(k) for k in sorted(sizes)])))
    rows = rows.select("row", F.when(F.col("at") < 0, F.col("doc")).alias("doc"), "n", "at", "k", "own", F.when(F.col("at") < 0, F.lit(_SELF)).otherwise(F.xxhash64("own")).alias("hash"))

    hashes = windows.select(F.col("hash").alias("known")).distinct().unionByName(rows.sparkSession.sql(f"select {_SELF}L as known")).distinct()
    if sum(sizes.values()) <= most_windows:
        hashes = F.broadcast(hashes)
    rows = rows.join(hashes, F.col("hash") == F.col("known"), "left_semi")
    items = windows.select(F.col("hash").alias("item_hash"), F.col("words").alias("item_words"), "items")
    # few rows are left by now; compared inside a function, or the words would become a join key
    same = F.exists(F.array("item_words"), lambda w: w == F.col("own"))
    found = rows.join(items, F.col("hash") == F.col("item_hash"), "left").where((F.col("at") < 0) | same)
    return found.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.max(F.col("n").cast("long")).alias("n_words"),
        F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "k", "items"))).alias("hits"),
    ).select("doc.*", "n_words", "hits")


def _contaminated(n_hit: Column, n_words: Column, percent: int) -> Column:
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5) -> DataFrame:
    """For every row: doc_id, n_words, n_hit (words in any hit), items and contaminated (n_hit of ``percent`` % or more)."""
    found = find_hits(docs.select(F.col("doc_id"), F.col("text").alias("text")), "text", benchmark, n)
    found = found.select("doc_id", "n_words", _coverage(F.col("hits")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"))
    return found.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words"), percent))


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5) -> DataFrame:
    """docs without contaminated rows; from other rows with hits, the words hit and what parts them are cut out.

    Hits are found first and written by id and text; then they are joined back to the rows that have some.
    """
    rows, doc_id, text = plain_names(docs)
    k1, k2 = (k.alias(c) for k, c in zip(text_keys(F.col(text)), ("k1", "k2"), strict=True))
    keyed = rows.select(F.col(doc_id).alias("id"), k1, k2, F.col(text).alias("text"))
    found = find_hits(keyed, "text", benchmark, n).withColumn("n_hit", _coverage(F.col("hits"))).where("n_hit > 0")
    found = found.select("id", "k1", "k2", _contaminated(F.col("n_hit"), F.col("n_words"), percent).alias("gone"), F.transform("hits", lambda h: F.struct(h["at"], h["k"])).alias("hits"))
    # rows that are equal in id and text have equal hits
    found = written(found.dropDuplicates(["id", "k1", "k2"]), "hits")
    k1, k2 = text_keys(F.col(text))
    same = F.col(doc_id).eqNullSafe(F.col("id")) & (k1 == F.col("k1")) & (k2 == F.col("k2"))
    rows = rows.join(found, same, "left").where(~F.coalesce("gone", F.lit(False)))
    parts = F.regexp_extract_all(F.col(text), F.lit(f"({WORD}+{BREAK}*)"), 1)
    left = F.filter(parts, lambda p, i: ~F.exists("hits", lambda h: (i >= h["at"]) & (i < h["at"] + h["k"])))
    rest = F.concat(F.regexp_extract(F.col(text), f"^{BREAK}*", 0), F.array_join(left, ""))
    cut = F.when(F.col("hits").isNotNull(), rest).otherwise(F.col(text))
    return rows.select(*[cut.alias(c) if c == text else F.col(c) for c in (f"c{k}" for k in range(len(docs.columns)))]).toDF(*docs.columns)
