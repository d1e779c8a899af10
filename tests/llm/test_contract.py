"""The registered queries on the smallest tables, column by column; odd rows and odd columns through every operator and stage."""

import collections
import hashlib
import math
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline
from test_operators import ASCII, PATHS, alnum, by_id, plain_cut, plain_rules, shingle_set, spaced, true_classes

from versomill.llm import bpe, decontam, hmm, licenses, neardup, quality, queries, substring, tokencount, tokenfile, toxicity
from versomill.llm.common import crc_mod, written

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def crc(k):
    return zlib.crc32(str(k).encode())


def test_every_query_is_here():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    found = queries.queries()[name](spark, SMALL)
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    want = con.sql(f"select {columns} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect()), key=str) == sorted(want, key=str)


def test_op1(spark, small):
    found = queries.op1_toxicity(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = by_id(found)
    assert set(rows) == set(small)
    assert all(r["held_out"] == (crc(k) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for k, r in rows.items())


def test_op1_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [r for r in queries.op1_toxicity(spark, MIDDLE).where("held_out").collect() if labels.get(r["doc_id"]) is not None]
    bad = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    good = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean(bad) >= 0.6 and np.mean(good) <= 0.03


def test_op2(spark, small):
    found = queries.op2_bpe_round_trip(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    t = Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    rows = by_id(found)
    for k, x in small.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert tuple(rows[k]) == (k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op3(spark, small):
    found = queries.op3_license_scan(spark, SMALL)
    assert [(n, t) for n, t in found.dtypes] == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    rows = by_id(found)
    for k, x in small.items():
        w, r = alnum(x), rows[k]
        places = sorted((i, label) for label, p in phrases.items() for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
        at, labels = [i for i, _ in places], sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_op4(spark, small):
    found = queries.op4_token_files(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    t, rows, at = Tokenizer.from_file(PATHS["byte_bpe_50k.json"]), by_id(found), 0
    for k in sorted(small):
        ids = np.array([*t.encode(small[k] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(rows[k][c] for c in ("start", "n_tokens", "ids_crc32")) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op5(spark, small):
    found = queries.op5_near_duplicates(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    ids = sorted(small)
    classes, sizes = true_classes([small[k] for k in ids], 3, 85)
    rows = by_id(found)
    assert [tuple(rows[k]) for k in ids] == [(k, n, ids[c], ids[c] == k) for k, c, n in zip(ids, classes, sizes)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_recall_of_near_duplicates(spark, k, percent):
    """Against all pairs of a thousand documents: links found over links there are."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = {d: shingle_set(t, k) for d, t in rows}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = collections.Counter((a, b) for ds in holders.values() for i, b in enumerate(ds) for a in ds[:i])
    links = [(a, b) for (a, b), m in shared.items() if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(docs, k, percent).collect()}
    recall = np.mean([got[a] == got[b] for a, b in links])
    print(f"links {len(links)}, recall {recall:.4f}")
    assert len(links) > 50 and recall >= 0.99


def test_op6(spark, small):
    found = queries.op6_substring_dedup(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "text": "string", "n_sentences": "bigint", "n_removed": "bigint"}
    ids = sorted(small)
    rows = by_id(found)
    assert [tuple(rows[k])[1:] for k in ids] == plain_cut([small[k] for k in ids], substring.MIN_WORDS)


def test_op7(spark, small):
    found = queries.op7_decontamination(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = alnum(r["text"])
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(r["item_id"]))
    sizes = sorted({len(w) for w in windows})
    rows = by_id(found)
    for k, x in small.items():
        w, hit, items = alnum(x), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found_items := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found_items
        want = (k, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert tuple(rows[k]) == want


def test_op8(spark, small):
    found = queries.op8_token_counts(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    sp, rows = sentencepiece.SentencePieceProcessor(model_file=PATHS["piece_bpe_32k.model"]), by_id(found)
    for k, x in small.items():
        n = len(sp.encode(x or ""))
        assert tuple(rows[k]) == (k, len((x or "").encode()), n, n > 4096)


def test_op9(spark, small):
    found = queries.op9_lm_scoring(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    words = {k: [*spaced((x or "").translate(ASCII)), None] for k, x in small.items()}
    c = collections.Counter(y for k, w in words.items() if crc(k) % 7 != 2 for y in w)
    n, v, rows = sum(c.values()), len(c), by_id(found)
    for k, w in words.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(k) % 7 == 2, len(w), sum(c[y] > 0 for y in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[y] + 1) / (n + v + 1)) for y in w), rel_tol=1e-9) and r["score"] < 0


def test_op10(spark, small):
    found = queries.op10_quality_rules(spark, SMALL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "anomaly": "double", "base_failed": "boolean", "kept": "boolean"} | {c: "bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for k, r in by_id(found).items():
        want = plain_rules(small[k])
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


# --- texts of all characters -----------------------------------------------------------------------------------------


def test_any_characters(spark):
    """Strings over U+0000 to U+00FF and other scripts, with all neighbours of quotes, letters, digits and spaces."""
    r = random.Random(5)
    signs = [chr(c) for c in range(256)] + list("  ''strevmlld019\n\t▁▁日本語🙂٠²Ⅷ　") + ["<|endoftext|>", "</s>", "<unk>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 18))) for _ in range(30_000)]
    around = ["'", "s", "t", "r", "9", " ", "  ", "\n", "\x1c", "\x1f", "\x85", "\xa0", "é", "."]
    texts += [a + c + b for c in map(chr, range(256)) for a in around for b in around[:6]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    t, sp = Tokenizer.from_file(PATHS["byte_bpe_50k.json"]), sentencepiece.SentencePieceProcessor(model_file=PATHS["piece_bpe_32k.model"])
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    encoded = by_id(bpe.encode(docs, PATHS["byte_bpe_50k.json"]))
    assert [encoded[k]["ids"] for k in range(len(texts))] == want
    files = by_id(tokenfile.through_files(docs, PATHS["byte_bpe_50k.json"], 2))
    assert [files[k]["ids_crc32"] for k in range(len(texts))] == [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in want]
    counts = by_id(tokencount.count_tokens(docs, PATHS["piece_bpe_32k.model"], size=300))
    assert [counts[k]["n_tokens"] for k in range(len(texts))] == [len(x) for x in sp.encode(texts)]


def test_vocabularies_that_are_not_understood():
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    small = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}, "pre_tokenizer": spec["pre_tokenizer"]}
    assert bpe.compile_merges(json.dumps(small).encode()).walk(b"abab") == [2, 2]
    for more in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**small["model"], "ignore_merges": True}}, {"added_tokens": [{"id": 3, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.compile_merges(json.dumps({**small, **more}).encode())
    with pytest.raises(ValueError):
        bpe.compile_merges(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())


# --- odd rows and columns --------------------------------------------------------------------------------------------

ODD = "doc_id long, text string, `a.b` string, __id long, __places array<long>, row long, words string, c0 int, c1 string, k1 long, gone boolean, hits string, doc struct<`x y`: int, text: string>, n_removed int, label int, places int, id long, digest string"
REST = ("p", 1, [1], 2, "w", 3, None, 4, True, "h", (1, "t"), 5, 6, 7, 8, "d")
NONE = (None,) * 16


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(120)]
    a = " ".join(f"{w}." if k % 9 == 8 else w for k, w in enumerate(words))
    long = " ".join(f"l{r.randrange(3000)}" for _ in range(700_000))
    rows = [(1, a), (1, a), (1, a + " other"), (2, a), (2, None), (None, a), (None, a), (None, None), (3, ""), (4, " \n "), (5, long), (6, "x" * 100_000), (7, "one two"), (8, "Stupid " + a)]
    return spark.createDataFrame([(i, t, *(NONE if k % 3 == 0 else REST)) for k, (i, t) in enumerate(rows)], ODD).repartition(3)


@pytest.fixture(scope="module")
def odd_folder(spark, odd, tmp_path_factory):
    """The odd rows as documents, with labels and a benchmark."""
    at = f"file://{tmp_path_factory.mktemp('odd')}"
    odd.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (None, 1, 1), (8, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    first = odd.where("doc_id = 7").collect()[0]["text"]
    spark.createDataFrame([(1, first), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def counted(df):
    return collections.Counter((r["doc_id"], hashlib.md5((r["text"] or "-").encode()).hexdigest()) for r in df.select("doc_id", "text").collect())


def test_odd_rows_through_every_query(spark, odd, odd_folder):
    n = odd.count()
    for name, query in queries.queries().items():
        found = query(spark, odd_folder)
        assert found.count() == n, name


def test_odd_columns_are_kept(spark, odd, odd_folder):
    labels, benchmark = spark.read.parquet(f"{odd_folder}/labels.parquet"), spark.read.parquet(f"{odd_folder}/benchmark.parquet")
    model = toxicity.fit(odd, labels)
    for kept in (toxicity.accepted(odd, model, 2.0), neardup.deduplicated(odd, 5, 101), substring.cleaned(odd, 10**6), decontam.cleaned(odd, benchmark.limit(0))):
        assert kept.columns == odd.columns and [f.dataType for f in kept.schema.fields] == [f.dataType for f in odd.schema.fields]
    assert counted(toxicity.accepted(odd, model, 2.0)) == counted(substring.cleaned(odd, 10**6)) == counted(decontam.cleaned(odd, benchmark.limit(0))) == counted(odd)
    whole = {str(r) for r in odd.collect()}
    assert {str(r) for r in substring.cleaned(odd, 10**6).collect()} == whole == {str(r) for r in decontam.cleaned(odd, benchmark.limit(0)).collect()}
    hit = decontam.cleaned(odd, benchmark)
    assert hit.where("doc_id = 7").count() == 0 and hit.where("doc_id = 3").count() == 1


def test_odd_rows_through_the_pipeline(spark, odd, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = counted(docs)
        docs = written(stage(spark, docs, odd_folder), name)
        assert docs.columns == odd.columns, name
        if name in ("toxicity", "near_dedup"):
            assert all(before[k] >= n for k, n in counted(docs).items())
    assert {r["doc_id"] for r in docs.collect()} >= {3, 4, None}
    final = corpus_pipeline.run(spark, odd_folder)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and final.count() > 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, odd_folder).count() == 0, name


def test_empty_tables(spark, odd, odd_folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_folder}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_very_many_rows_without_ids(spark):
    """Spans go to the row that they are of, however many rows share an id or have none."""
    r = random.Random(6)
    common = " ".join(f"c{r.randrange(10**6)}" for _ in range(30)) + "."
    texts = [" ".join(f"u{r.randrange(10**9)}" for _ in range(r.randint(1, 60))) + ". " + (common if k % 100 == 0 else "end.") for k in range(20_000)]
    docs = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = substring.dedup(docs).select("doc.*", F.col("n_removed").alias("cut")).collect()
    assert len(got) == len(texts)
    removed = [x for x in got if x["cut"]]
    # one of all that hold the passage keeps it; all that are cut held it, and lost just its sentences
    assert len(removed) == 199 and sum(common in x["text"] for x in got) == 1
    assert sorted(x["text"] for x in got if not x["cut"] and common not in x["text"]) == sorted(t for t in texts if common not in t)
    whole = {t.removesuffix(common): t for t in texts if common in t}
    assert all(x["text"] in whole for x in removed)


def test_licenses_of_neighbours(spark):
    texts = {
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "agpl": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "cc0": "CC0 1.0 Universal: to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "": "the general public and a free license for all",
    }
    rows = [(k, f"some words before {t} and some behind") for k, t in enumerate(texts.values())]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: got[k]["labels"] for k, _ in rows} == dict(enumerate(texts))


def test_scores_of_held_out_texts(spark):
    """The model beats the base by a margin on rows that it did not learn from."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    s = hmm.score(docs, crc_mod("doc_id", 7) != 2).where("not train").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).collect()[0]
    print(f"log10 a token: {s['s']:.3f}, base {s['b']:.3f}")
    assert s["s"] > s["b"] + 0.05


def test_threshold_uses_both_labels():
    """Rows that the forest was not grown on set the threshold: as high as the same bad rows are still rejected."""
    r = np.random.default_rng(4)
    good, bad = r.normal(0, 1, (400, 4)), r.normal(6, 1, (40, 4))
    x = np.vstack([good, bad])
    forest = quality.fit_forest(good[:200], x.min(0), x.max(0))
    rest, is_good = np.vstack([good[200:], bad]), np.arange(240) < 200
    limit = quality.calibrated(forest, rest, is_good, 0.99)
    s = forest.score(rest)
    low = np.quantile(s[:200], 0.99)
    assert limit >= low and ((s[200:] > limit) == (s[200:] > low)).all() and (s[:200] > limit).mean() <= 0.01
