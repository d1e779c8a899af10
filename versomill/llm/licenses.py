"""License scans by a positional index of rare tokens, with DataFrame functions only.

Templates are short word sequences with a label.  Their words' document counts over
the whole corpus give each word's IDF, and each template is indexed by its words of
highest IDF: (word, place in the template).  In a document the indexed words' places
are looked up; a word at place p that the template has at place q proposes a start at
p - q, and a start is kept where the template's other indexed words stand at their
relative places too.  Then the mandatory key phrase is compared word by word.  For
templates marked exact the key phrase is the whole template, so nothing else than
its places pass, and none is missed: each place has the rarest word in it.

All is done within a document's row: no shuffle but the one that sums document
counts of the templates' few hundred words.  Null and empty texts have no words; texts
of any length are scanned whole.  Rows are judged one by one, so repeated rows, ids and
rows without an id do not matter; labels that tie are all given, sorted.  Only doc_id and
text are read, so other columns may have any names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents
from .native import word_array


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str  # the mandatory phrase, a part of words
    exact: bool = False


#: Phrases and labels of the base result, then words of well-known licenses' notices.
BASE = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
FURTHER = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "any person obtaining a copy of this software and associated documentation files"),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    Template("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "used to endorse or promote products derived from this software"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("artistic-2", "you may distribute it under the terms of the artistic license 2 0", "artistic license 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    Template("ofl-1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced", "all rights reserved"),
)
#: Indexed words of a template, and the share of their IDF that must stand in place.
RARE, IN_PLACE = 4, 0.6


def word_idf(words: DataFrame, terms: list[str]) -> dict[str, float]:
    """IDF of the templates' words over all documents; one row a word comes to the driver."""
    wanted = F.array(*map(F.lit, terms))
    found = words.select(F.explode(F.concat(F.array_intersect("words", wanted), F.array(F.lit("")))).alias("term"))
    counts = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = counts.get("", 0)  # the empty term stands once in each document
    return {t: math.log((n + 1) / (counts.get(t, 0) + 0.5)) + 1 for t in terms}


def _indexed(t: Template, idf: dict[str, float]) -> list[tuple[str, int, float]]:
    """The template's rarest words: (word, place, IDF); the first place of a word that comes twice."""
    own = t.words.split()
    first = {w: own.index(w) for w in own}
    return [(w, first[w], idf[w]) for w in sorted(first, key=lambda w: (-idf[w], first[w]))[: 1 if t.exact else RARE]]


def _place(words: str, part: str) -> int:
    own, key = words.split(), part.split()
    return next(i for i in range(len(own)) if own[i : i + len(key)] == key)


def _starts(t: Template, idf: dict[str, float]) -> Column:
    """Verified starts of a template, from ``words`` and the places ``rare`` of indexed words."""
    index = _indexed(t, idf)
    key, place = t.key.split(), _place(t.words, t.key)

    def proposed(word, q):
        return F.transform(F.filter("rare", lambda x: x["w"] == word), lambda x: x["i"] - q)

    def mass(s):
        return sum((F.when(F.get("words", s + q) == w, v).otherwise(0.0) for w, q, v in index), F.lit(0.0))

    total = sum(v for _, _, v in index)
    starts = F.array_distinct(F.concat(*[proposed(w, q) for w, q, _ in index]))
    phrase = F.array(*map(F.lit, key))
    return F.filter(starts, lambda s: (s + place >= 0) & (mass(s) >= IN_PLACE * total - 1e-9) & (F.slice("words", F.greatest(s + place, F.lit(0)) + 1, len(key)) == phrase))


def _share(t: Template, idf: dict[str, float], starts: Column) -> Column:
    """Greatest IDF-weighted share of the template's words that stand in place at a start."""
    own = t.words.split()
    total = sum(idf[w] for w in own)
    at = F.transform(starts, lambda s: sum((F.when(F.get("words", s + q) == w, idf[w]).otherwise(0.0) for q, w in enumerate(own)), F.lit(0.0)) / total)
    return F.coalesce(F.array_max(at), F.lit(0.0))


def _labels(found: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for label, s in found])))), ",")


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, further: tuple[Template, ...] = FURTHER) -> DataFrame:
    """For every row: doc_id, n_words, places of base phrases (first words, from 0), base_labels, labels of all templates and score."""
    rows = documents(docs).select("doc_id", word_array(F.col("text")).alias("words"))
    terms = sorted({w for t in (*base, *further) for w in t.words.split()})
    idf = word_idf(rows, terms)
    indexed = sorted({w for t in (*base, *further) for w, _, _ in _indexed(t, idf)})
    wanted = F.array(*map(F.lit, indexed))

    # most documents have no indexed word and stop at the first test
    place = F.filter(F.transform("words", lambda w, i: F.when(w.isin(indexed), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    none = F.expr("cast(array() as array<struct<i: int, w: string>>)")
    rows = rows.select("doc_id", "words", F.when(F.arrays_overlap("words", wanted), place).otherwise(none).alias("rare"))

    empty = F.expr("cast(array() as array<int>)")
    templates = [*base, *further]
    rows = rows.select("doc_id", "words", *[F.when(F.size("rare") > 0, _starts(t, idf)).otherwise(empty).alias(f"s{k}") for k, t in enumerate(templates)])
    starts = [F.col(f"s{k}") for k in range(len(templates))]
    places = F.array_sort(F.concat(*starts[: len(base)]))
    score = F.greatest(*[_share(t, idf, s) for t, s in zip(templates, starts, strict=True)])
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.transform(places, lambda s: s.cast("long")).alias("places"),
        _labels([(t.label, s) for t, s in zip(base, starts, strict=False)]).alias("base_labels"),
        _labels([(t.label, s) for t, s in zip(templates, starts, strict=True)]).alias("labels"),
        F.round(score, 6).alias("score"),
    )
