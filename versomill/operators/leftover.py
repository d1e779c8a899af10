"""Asking engines again for texts with words left over from the source language."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import engines as E

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _spans(text: str, left: set[str]) -> list[tuple[int, int]]:
    """Maximal runs of left-over words with only white space between them."""
    out: list[list[int]] = []
    for m in _WORD.finditer(text):
        if re.split("['’]", m[0])[0] in left:
            if out and not text[out[-1][1] : m.start()].strip():
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
    return [(a, b) for a, b in out]


def _count(text: str, left: set[str]) -> int:
    return sum(re.split("['’]", m[0])[0] in left for m in _WORD.finditer(text))


def _ask(engine: E.Engine, text: str) -> str | None:
    """A result, or None for whatever fails or is blank."""
    try:
        r = engine.translate([text])[0]
    except Exception:  # noqa: BLE001 - another engine may do
        return None
    return r if r and r.strip() else None


def _in_case(word: str, like: str, target: str) -> str:
    """A result in the case of the run that it replaces."""
    if like.isupper():
        return (word.replace("i", "İ") if target == "tr" else word).upper()
    if like[:1].isupper() and word:
        return ("İ" if target == "tr" and word[0] == "i" else word[0].upper()) + word[1:]
    return word


def improve(text: str, left: set[str], chain: list[E.Engine], target: str = "") -> tuple[str, int]:
    """The text with fewer left-over words, and how many stay.

    First the whole text by each engine, as long as some are left and a result has
    strictly fewer; then each run, from right to left, in lower case where it begins with
    a capital (engines keep capitalised words as names) and put back in its own case.
    """
    best, n = text, _count(text, left)
    lead, tail = re.match(r"\s*", text)[0], re.search(r"\s*\Z", text)[0]
    for e in chain:
        if not n:
            break
        r = _ask(e, text.strip())
        if r is not None and (k := _count(r, left)) < n:
            best, n = lead + r.strip() + tail, k
    for a, b in reversed(_spans(best, left)):
        run = best[a:b]
        for e in chain:
            r = _ask(e, run.lower() if run[:1].isupper() else run)
            if r is None:
                continue
            r = _in_case(r.strip(), run, target)
            if r.lower() != run.lower() and _count(r, left) < _count(run, left):
                best = best[:a] + r.rstrip(".") + best[b:]
                break
    return best, _count(best, left)


def retranslate(nodes: DataFrame, leftovers: DataFrame, engines: list[str], src: str = "en", tgt: str = "tr", keys: tuple[str, ...] = ("doc_index", "node")) -> DataFrame:
    """nodes (keys, text) plus fixed and words_left.

    ``leftovers`` (keys, word) names each node's left-over words; nodes without any pass
    by the engines.
    """
    words = leftovers.groupBy(*keys).agg(F.to_json(F.collect_set("word")).alias("left"))
    rows = nodes.join(words, list(keys), "left")

    makers = [E.maker(n, src, tgt) for n in engines]

    def run(frames):
        chain = [m() for m in makers]
        for pdf in frames:
            done = [improve(t, set(json.loads(x)), chain, tgt) if isinstance(x, str) else (t, 0) for t, x in zip(pdf["text"], pdf["left"])]
            yield pdf.drop(columns="left").assign(fixed=[t for t, _ in done], words_left=[n for _, n in done])

    columns = [c for c in rows.columns if c != "left"]
    schema = StructType([*[rows.schema[c] for c in columns], StructField("fixed", StringType()), StructField("words_left", IntegerType())])
    return rows.select(*columns, "left").mapInPandas(run, schema)


def totals(fixed: DataFrame) -> DataFrame:
    """Nodes checked, fixed and left, and words left."""
    return fixed.agg(F.count("*").alias("nodes_checked"), F.count_if(F.col("fixed") != F.col("text")).alias("nodes_fixed"), F.count_if(F.col("words_left") > 0).alias("nodes_left"), F.coalesce(F.sum("words_left"), F.lit(0)).alias("words_left"))


def sample(fixed: DataFrame, leftovers: DataFrame, n: int = 20) -> DataFrame:
    """The first n nodes with words left: 200 characters of text and ten words each."""
    words = leftovers.groupBy("doc_index", "node").agg(F.slice(F.array_sort(F.collect_set("word")), 1, 10).alias("words"))
    return fixed.where("words_left > 0").join(words, ["doc_index", "node"]).orderBy("doc_index", "node").limit(n).select("doc_index", "node", F.substring("fixed", 1, 200).alias("text"), "words")
