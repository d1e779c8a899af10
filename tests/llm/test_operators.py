"""Each operator against a plain version on small rows that hold the awkward cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versomill.llm import bpe, components, decontam, hmm, licenses, neardup, quality, substring, textnum, tokencount, tokenfile, toxicity
from versomill.llm.common import crc_mod

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATHS = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, hits int, n_words long, words string, row string"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def sentence(r, n):
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ré", "tu", "sen", "ö"]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def make_texts():
    r = random.Random(7)
    base = [" ".join(sentence(r, r.randint(4, 14)) for _ in range(r.randint(2, 14))) for _ in range(60)]
    shared = " ".join(sentence(r, 9) for _ in range(8))
    texts = base + base[:10] + [t.replace(" ", "\n", 2) for t in base[10:16]]
    for t in base[20:40]:
        w = t.split(" ")
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{a} {shared} {b}" for a, b in zip(base[40:50], base[50:60])]
    texts += [
        None,
        "",
        " \n\t ",
        "word",
        "two words",
        "x " * 30_000,
        "long" * 20_000,
        "A.\nA.\nA.\n\nB\n",
        "# $ | <b> & * %",
        "İstanbul Ä ÉÉ É tail",
        "Released UNDER the MIT License. Under the mit license cc by-nc; Apache License, Version 2.0",
        "under the mit licenses; the mit license. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "<|endoftext|> and a<|endoftext|>b <s> </s>  ▁ x",
        "日本語のテキスト 🙂  　 \x00 end",
    ]
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", 1, 5, 6, 7, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tied(spark):
    """Rows that repeat, share ids or have none, with nulls in any column."""
    a = "One two three four five six seven eight nine ten. " * 3
    rows = [(1, a), (1, a), (1, a + " other"), (2, a), (None, a), (None, None), (3, None), (3, "")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_hashes_have_no_pattern():
    """Words that polynomials modulo powers of two cannot tell apart."""
    x, y = thue_morse(4096), thue_morse(4096, "b", "a")
    h = textnum.word_hashes(*textnum.buffers(pa.array([f"{x} {y}"]))[:1], *textnum.words(*textnum.buffers(pa.array([f"{x} {y}"])))[:2], lower=True)
    assert len(set(h.tolist())) == 2
    assert quality.rule_stats(pa.array([f"{x}\n{y}\n{x}"]))[0, 3] == 1
    r = random.Random(2)
    seen = {"".join(r.choice("ab") for _ in range(r.randint(1, 90))) for _ in range(20_000)}
    buf, offs = textnum.buffers(pa.array([" ".join(seen)]))
    starts, ends, _ = textnum.words(buf, offs)
    ranges = textnum.Ranges(buf, False)
    assert len(set(ranges.of(starts, ends).tolist())) == len(set(ranges.of(starts, ends, seed=1).tolist())) == len(seen)
    order = np.array(r.sample(range(len(starts)), len(starts)))
    assert not ranges.same_bytes(starts, ends, starts[order], ends[order])[order != np.arange(len(order))].any()
    assert ranges.same_bytes(starts, ends, starts, ends).all()


def test_equal_hashes_of_unequal_bytes_are_told_apart(texts, monkeypatch):
    """Even with a hash of three values the counts of op10 are right."""
    want = quality.rule_stats(pa.array(texts[:40], pa.string()))
    real = textnum.Ranges.of
    monkeypatch.setattr(textnum.Ranges, "of", lambda self, s, e, seed=0: real(self, s, e, seed) % np.uint64(3))
    monkeypatch.setattr(textnum, "mix", lambda h: h)
    assert (quality.rule_stats(pa.array(texts[:40], pa.string())) == want).all()


def test_word_hashes_tell_words_apart():
    words_ = ["a", "b", "ab", "ba", "aa", "aab", "aba", "baa", "", "é", "É", "A"]
    h = textnum.word_hashes(np.frombuffer(" ".join(words_).encode(), np.uint8), *textnum.words(*textnum.buffers(pa.array([" ".join(words_)])))[:2], lower=True)
    plain = [w.translate(ASCII) for w in words_ if w]
    assert len(set(h.tolist())) == len(set(plain))


def test_bpe_equals_library(docs, texts, empty, tied):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    got = by_id(bpe.round_trip(docs, PATHS["byte_bpe_50k.json"]))
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(docs, PATHS["byte_bpe_50k.json"])
    assert {k: r["text"] for k, r in by_id(bpe.decode(encoded, PATHS["byte_bpe_50k.json"])).items()} == {k: x or "" for k, x in enumerate(texts)}
    assert bpe.round_trip(empty, PATHS["byte_bpe_50k.json"]).count() == 0
    assert bpe.round_trip(tied, PATHS["byte_bpe_50k.json"]).count() == 8


def test_automaton_equals_merging():
    """On a small vocabulary, the automaton's walks are what merging in order gives."""
    import json

    letters = "ab"
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("b", "b"), ("aa", "b"), ("ab", "aba"), ("bb", "bb")]
    vocab = {c: k for k, c in enumerate(letters)}
    for u, v in merges:
        vocab[u + v] = len(vocab)
    a = bpe.compile_merges(json.dumps({"model": {"vocab": vocab, "merges": [list(m) for m in merges]}}).encode())

    def merged(word):
        parts = list(word)
        for u, v in merges:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (u, v):
                    parts[k : k + 2] = [u + v]
                k += 1
        return [vocab[p] for p in parts]

    import itertools

    for n in range(1, 12):
        for w in itertools.product(letters, repeat=n):
            w = "".join(w)
            assert a.walk(w.encode()) == merged(w), w


def test_token_counts_equal_library(docs, texts, empty, tied):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS["piece_bpe_32k.model"])
    got = by_id(tokencount.count_tokens(docs, PATHS["piece_bpe_32k.model"], size=50))
    for k, x in enumerate(texts):
        n = len(sp.encode(x or ""))
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((x or "").encode()), n, n > 4096)
    assert tokencount.count_tokens(empty, PATHS["piece_bpe_32k.model"]).count() == 0
    assert tokencount.count_tokens(tied, PATHS["piece_bpe_32k.model"]).count() == 8


def test_byte_coding_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (tokenfile.unpack(*tokenfile.pack(x), n) == x).all()
    with pytest.raises(ValueError):
        tokenfile.read_block(b"nope" + bytes(40))


def test_token_files(docs, texts, empty, tied, spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    path = f"file://{tmp_path}/tokens"
    got = by_id(tokenfile.through_files(docs, PATHS["byte_bpe_50k.json"], 2, path))
    stored = by_id(tokenfile.token_ids(spark, path))
    at = 0
    for k, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert stored[k]["ids"] == ids.tolist()
        at += len(ids)
    assert tokenfile.through_files(empty, PATHS["byte_bpe_50k.json"]).count() == 0
    rows = sorted(tokenfile.through_files(tied, PATHS["byte_bpe_50k.json"]).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 1, 2, 3, 3]
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]


def test_license_scan(docs, texts, empty, tied):
    got = by_id(licenses.scan(docs))
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for k, x in enumerate(texts):
        w, places, labels = alnum(x), [], set()
        for label, p in phrases.items():
            p = p.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (got[k]["n_words"], got[k]["places"], got[k]["base_labels"]) == (len(w), sorted(places), ",".join(sorted(labels)))
        assert labels <= set(got[k]["labels"].split(",")) | {""}
        assert 0 <= got[k]["score"] <= 1
    granted = next(k for k, x in enumerate(texts) if x and "hereby granted" in x)
    assert got[granted]["labels"] == "mit" and got[granted]["base_labels"] == ""
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(tied).count() == 8


def item_hits(words_, items, n=13):
    covered, found = set(), set()
    for item, w in items:
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for at in range(len(words_) - k + 1):
                if words_[at : at + k] == w[i : i + k]:
                    covered |= set(range(at, at + k))
                    found.add(str(item))
    return covered, found


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    rows = [(1, texts[0]), (2, " ".join(alnum(texts[3])[4:30])), (10, "two words"), (11, None), (12, ""), (None, texts[1]), (2, texts[5]), (13, texts[0])]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("most_windows, most_anchors", [(10**6, 10**4), (0, 10**4), (10**6, 0)])
def test_decontamination(docs, texts, benchmark, most_windows, most_anchors, monkeypatch):
    monkeypatch.setattr(decontam.find_hits, "__defaults__", (13, None, most_windows, most_anchors))
    got = by_id(decontam.decontaminate(docs, benchmark))
    items = [(r["item_id"], alnum(r["text"])) for r in benchmark.collect() if r["item_id"] is not None]
    for k, x in enumerate(texts):
        if x and len(x) > 50_000:
            continue
        w = alnum(x)
        covered, found = item_hits(w, items)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(covered), sorted(found))
        assert r["contaminated"] == (len(covered) > 0 and 20 * len(covered) >= len(w))


def test_decontamination_cuts(docs, texts, benchmark, empty, tied, spark):
    cleaned = by_id(decontam.cleaned(docs, benchmark, percent=60))
    items = [(r["item_id"], alnum(r["text"])) for r in benchmark.collect() if r["item_id"] is not None]
    for k, x in enumerate(texts):
        if x and len(x) > 50_000:
            continue
        w = alnum(x)
        covered, _ = item_hits(w, items)
        if covered and 100 * len(covered) >= 60 * len(w):
            assert k not in cleaned
        elif covered:
            assert alnum(cleaned[k]["text"]) == [y for i, y in enumerate(w) if i not in covered]
        else:
            assert cleaned[k]["text"] == x
    assert decontam.cleaned(docs, benchmark).columns == docs.columns
    none = benchmark.limit(0)
    assert decontam.decontaminate(empty, benchmark).count() == 0
    assert decontam.decontaminate(docs, none).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(tied, benchmark).count() == 8


def shingle_set(text, k):
    w = spaced((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def true_classes(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, k, percent):
    got = by_id(neardup.classes(docs, k, percent))
    classes, sizes = true_classes(texts, k, percent)
    assert [(got[i]["component_id"], got[i]["n_shingles"]) for i in range(len(texts))] == list(zip(classes, sizes))


def test_near_duplicates_within_large_buckets(spark, monkeypatch):
    """Chains of documents that a bucket's centre is not alike to: found by the pairs of open buckets, in blocks too."""
    r = random.Random(3)
    w = sentence(r, 400).split(" ")
    rows = [(0, " ".join(w))]
    for k in range(1, 60):
        for _ in range(4):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    want = true_classes([t for _, t in rows], 3, 85)[0]
    for small in (2, 1000):
        monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
        monkeypatch.setattr(neardup, "BLOCK", 8)
        got = by_id(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
        assert [got[k]["component_id"] for k in range(len(rows))] == want


def test_near_duplicates_in_a_dense_group(spark, monkeypatch):
    """Documents just below and just above the threshold of one another, with common shingles only: gone through in blocks of sets."""
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(420)]
    rows = []
    for k in range(70):
        w = list(base)
        for i in r.sample(range(420), 5 + k % 4):
            w[i] = f"z{i}"
        rows.append((k, " ".join(w)))
    want = true_classes([t for _, t in rows], 5, 80)[0]
    assert 1 < len(set(want)) < 70
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "RARE", 2)
    met = []
    real = neardup._large_pairs
    monkeypatch.setattr(neardup, "_large_pairs", lambda *a: met.append(1) or real(*a))
    for size in (8, 512):
        monkeypatch.setattr(neardup, "BLOCK", size)
        got = by_id(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80))
        assert [got[k]["component_id"] for k in range(len(rows))] == want
    assert len(met) == 2


@pytest.mark.parametrize("k, percent, n, more, changes", [(3, 85, 700, 115, 1), (5, 80, 1500, 358, 1)])
def test_near_duplicates_of_longer_copies(spark, k, percent, n, more, changes):
    """Copies with so much appended that the sizes' ratio is just above the threshold, and a word changed."""
    r = random.Random(11)
    rows = []
    for i in range(16):
        w = [f"w{r.randrange(10**9)}" for _ in range(n + more)]
        rows.append((2 * i, " ".join(w[:n])))
        for _ in range(changes):
            w[r.randrange(k, n - k)] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    sets = [shingle_set(t, k) for _, t in rows[:2]]
    assert percent <= 100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1]) and 99 * len(sets[0]) < percent * len(sets[1])
    got = by_id(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), k, percent))
    assert [got[j]["component_id"] for j in range(len(rows))] == [j - j % 2 for j in range(len(rows))]


def test_near_duplicates_odd_rows(empty, tied):
    assert neardup.classes(empty).count() == 0
    rows = neardup.classes(tied, 3, 85).collect()
    assert len(rows) == 8
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (None, 3))
    kept = neardup.deduplicated(tied, 3, 80)
    assert kept.columns == tied.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "3", "None", "None"]


def test_near_duplicates_of_shared_ids(spark):
    """A row goes by its own text, not because another row of its id goes."""
    r = random.Random(13)
    x, y = (" ".join(f"w{r.randrange(10**9)}" for _ in range(60)) for _ in range(2))
    rows = [(3, x), (5, x), (5, y), (9, y + " more")]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted(tuple(z) for z in kept.collect()) == sorted([rows[0], rows[2]])


def test_toxicity_sample_is_not_cut():
    assert toxicity.SAMPLE == 4000


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {x["v"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for v in {x for e in edges if e[0] != e[1] for x in e}:
        seen, todo = {v}, [v]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[v] == min(seen)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_cut(texts, min_words):
    seen, marks, split = {}, collections.defaultdict(set), {}
    for i, x in enumerate(texts):
        x = x or ""
        found, sents, current = list(re.finditer(r"[^\x20\x09-\x0D]+", x)), [], []
        for n, m in enumerate(found):
            current.append(m)
            if re.search(r"[.!?][\"')\]}]?$", m.group()) or n == len(found) - 1 or "\n" in x[m.end() : found[n + 1].start()]:
                sents += [current[a : a + 20] for a in range(0, len(current), 20)]
                current = []
        split[i] = sents
        spans = set()
        for a in range(len(sents)):
            for step in (1, -1):
                c, b = 0, a
                while 0 <= b < len(sents):
                    c += len(sents[b])
                    if c >= min_words:
                        spans.add((min(a, b), max(a, b)))
                        break
                    b += step
        for a, b in sorted(spans):
            key = tuple(m.group().translate(ASCII) for s in sents[a : b + 1] for m in s)
            if key in seen:
                marks[i] |= set(range(a, b + 1))
            else:
                seen[key] = i
    out = []
    for i, x in enumerate(texts):
        begins = [s[0].start() for s in split[i]]
        stops = [*begins[1:], len(x or "")]
        text = (x[: begins[0]] if begins else x) if x else x
        out.append((text if x is None else text + "".join(x[b:e] for k, (b, e) in enumerate(zip(begins, stops)) if k not in marks[i]), len(split[i]), len(marks[i])))
    return out


def test_substring_dedup(docs, texts, empty, tied):
    got = by_id(substring.dedup(docs, 25).select("doc.*", F.col("n_sentences").alias("total"), F.col("n_removed").alias("removed")))
    assert [(got[k]["text"], got[k]["total"], got[k]["removed"]) for k in range(len(texts))] == plain_cut(texts, 25)
    assert substring.dedup(empty).count() == 0
    rows = substring.dedup(tied).select("doc.*").collect()
    assert len(rows) == 8
    # rows equal in id and text are one document: both stay whole, as the first ones, or both are cut
    assert len({r["text"] for r in rows if r["doc_id"] == 2}) == 1


def test_substring_dedup_without_broadcast(docs, texts, spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = by_id(substring.dedup(docs, 25).select("doc.*"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [got[k]["text"] for k in range(len(texts))] == [x for x, _, _ in plain_cut(texts, 25)]


def test_lm_scoring(docs, texts, empty, tied):
    got = by_id(hmm.score(docs, crc_mod("doc_id", 7) != 2, rounds=1))
    w = [[*spaced((x or "").translate(ASCII)), None] for x in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    c = collections.Counter(y for k, x in enumerate(w) if not held[k] for y in x)
    n, v = sum(c.values()), len(c)
    for k, x in enumerate(w):
        r = got[k]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not held[k], len(x), sum(c[y] > 0 for y in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[y] + 1) / (n + v + 1)) for y in x), rel_tol=1e-9)
        assert r["score"] < 0
    assert hmm.score(empty, F.lit(True)).count() == 0
    assert hmm.score(docs, F.lit(False)).where("n_known > 0").count() == 0
    assert hmm.score(tied, F.lit(True)).count() == 8


def test_lm_rare_words_by_join(docs, texts, monkeypatch):
    """With few frequent words the same scores come by the join."""
    want = by_id(hmm.score(docs, F.lit(True), rounds=0))
    monkeypatch.setattr(hmm, "FREQUENT", 40)
    got = by_id(hmm.score(docs, F.lit(True), rounds=0))
    for k in range(len(texts)):
        assert math.isclose(got[k]["base_score"], want[k]["base_score"], rel_tol=1e-9)
        assert got[k]["n_known"] == want[k]["n_known"]


def test_forward_recursion_and_expected_counts():
    r = np.random.default_rng(2)
    model = hmm.first_model(r.random(hmm.CLASSES) + 0.01, 3)
    rows = [r.integers(0, hmm.CLASSES - 1, n).astype(np.uint16) for n in (0, 1, 5, 40)]
    got = hmm.log_likelihoods(model, rows)
    for x, y in zip(rows, got):
        p = model.start
        for t, k in enumerate([*x.tolist(), hmm.END]):
            p = (p @ model.move if t else p) * model.emit[k]
        assert math.isclose(y, math.log10(p.sum()), rel_tol=1e-9)
    # one short row: against sums over all paths
    x = [4, 9, hmm.END]
    starts, moves, emits = hmm.expected(model, [np.array(x[:-1])])
    import itertools

    total, want = 0.0, np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=3):
        p = model.start[path[0]] * model.emit[x[0], path[0]]
        for t in (1, 2):
            p *= model.move[path[t - 1], path[t]] * model.emit[x[t], path[t]]
        total += p
        for t in (1, 2):
            want[path[t - 1], path[t]] += p
    assert np.allclose(moves, want / total, rtol=1e-3)


def plain_expected(m, rows):
    """The forward-backward recursion over each whole row, one token at a time."""
    k = len(m.start)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
    for x in rows:
        o, f = [*x.tolist(), hmm.END], []
        back = [np.ones(k)] * len(o)
        for t, c in enumerate(o):
            p = (f[-1] @ m.move if t else m.start) * m.emit[c]
            f.append(p / p.sum())
        for t in range(len(o) - 2, -1, -1):
            q = m.move @ (m.emit[o[t + 1]] * back[t + 1])
            back[t] = q / q.sum()
        for t, c in enumerate(o):
            g = f[t] * back[t]
            emits[c] += g / g.sum()
            if t:
                j = f[t - 1][:, None] * m.move * (m.emit[c] * back[t])[None]
                moves += j / j.sum()
            else:
                starts += g / g.sum()
    return starts, moves, emits


def test_expected_counts_over_whole_rows():
    """Rows of one stretch, of several, and of just as many tokens as stretches hold."""
    r = np.random.default_rng(2)
    model = hmm.first_model(r.random(hmm.CLASSES) + 0.01, 3)
    model.move = r.dirichlet([1, 1, 1], 3)
    rows = [r.integers(0, hmm.CLASSES - 1, n).astype(np.uint16) for n in (0, 1, 5, 62, 63, 64, 127, 128, 700)]
    for got, want in zip(hmm.expected(model, rows), plain_expected(model, rows)):
        assert np.allclose(got, want, rtol=1e-3, atol=1e-4)


def test_lm_scores_do_not_depend_on_partitions(spark, docs):
    where = crc_mod("doc_id", 7) != 2
    one, many = by_id(hmm.score(docs.coalesce(1), where)), by_id(hmm.score(docs.repartition(5), where))
    assert all(math.isclose(one[k]["score"], many[k]["score"], abs_tol=1e-3, rel_tol=1e-5) for k in one)


def test_lm_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = hmm.score(docs, crc_mod("doc_id", 7) != 2).where("not train").agg(F.sum("score"), F.sum("base_score")).collect()[0]
    assert s[0] > s[1]


def test_lm_frequent_words_fill_their_bound(docs, monkeypatch):
    """All words alike rare: as many as the bound allows still have classes of their own."""
    docs = docs.select(F.explode(F.sequence(F.lit(0), F.lit(400))).alias("doc_id")).distinct().withColumn("text", F.concat(F.lit("w"), "doc_id"))
    monkeypatch.setattr(hmm, "FREQUENT", 200)
    counts = hmm.word_counts(docs.withColumn("train", F.lit(True)), "train")
    found = hmm.gathered(counts, 401)
    assert 150 < len(found.keys) <= 200 and (found.own >= 0).all()


def plain_rules(text):
    text = text or ""
    w, seen, dup = spaced(text), set(), 0
    for line in text.split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_quality_rules(docs, texts, empty, tied, spark):
    stats = quality.rule_stats(pa.array(texts, pa.string()))
    assert stats[:, :5].tolist() == [plain_rules(x) for x in texts]
    labels = spark.createDataFrame([(k, int(k % 9 > 0), None) for k in range(len(texts))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    none = labels.limit(0)
    assert all(r["kept"] != r["base_failed"] for r in quality.quality(docs, none).collect())
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(tied, labels).count() == 8


@pytest.mark.parametrize("at_once", [1 << 16, 50])
def test_quality_is_learned_from_all_labelled_rows(spark, tmp_path, monkeypatch, at_once):
    """More than 20,000 labelled rows, some of one id: nodes, ranges and threshold are those of a plain fit on all of them."""
    monkeypatch.setattr(quality, "AT_ONCE", at_once, raising=False)
    word = lambda k: F.substring(F.sha1(F.concat_ws(" ", "row", k)), 1, 2 + F.pmod(F.hash("row", k), F.lit(7)))
    marked = lambda k: F.when(F.col("row") % 11 == 0, F.concat(word(k), F.lit("#|"))).otherwise(word(k))
    rows = spark.range(24_000, numPartitions=5).select(F.col("id").alias("row"), F.when(F.col("id") < 40, 7).otherwise(F.col("id")).alias("doc_id"))
    rows = rows.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), 45 + F.pmod(F.hash("row"), F.lit(20))), marked), " "))
    rows.write.parquet(f"{tmp_path}/rows")
    docs = spark.read.parquet(f"{tmp_path}/rows")
    labels = docs.select("doc_id", F.expr("int(row % 11 > 0 or row < 40)").alias("quality")).distinct()
    plain = docs.join(labels, "doc_id").select("row", "text", "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("other")).toPandas()
    stats = quality.rule_stats(pa.array(plain["text"], pa.string()))
    ok, x, good, other = ~quality.base_failed(stats), quality.features(stats), plain["quality"].to_numpy() > 0, plain["other"].to_numpy()
    assert len(plain) == 24_000 and ok.sum() > 15_000
    forest = quality.fit_forest(x[ok & good & ~other], x[ok].min(0), x[ok].max(0))
    limit = quality.calibrated(forest, x[ok & (other | ~good)], good[ok & (other | ~good)], 0.995)
    score = forest.score(x)
    kept = ok & (score <= limit)
    want = sorted((int(a[0]), int(a[1]), round(b, 9), bool(k)) for a, b, k in zip(stats, score.tolist(), kept))
    assert sorted((r["n_words"], r["word_chars"], round(r["anomaly"], 9), r["kept"]) for r in quality.quality(docs, labels).collect()) == want
    assert kept[ok & good].mean() > 0.99


def test_quality_with_one_extreme_row():
    """One row far from all others, as among very many there is one, takes nothing from what is learned of the others."""
    r = np.random.default_rng(5)
    n = np.full(3_000, 200)
    stats = np.column_stack([n, 1000 + r.integers(0, 100, 3_000), r.integers(0, 3, 3_000), n * 0, n * 0, n // 10, n * 0, n * 0, n])
    bad = np.arange(3_000) % 20 == 0
    stats[bad, 1] += 600
    stats[0, 1] = 200 * 1_000_000
    x = quality.features(stats)
    half = np.arange(3_000) % 3 == 0
    forest = quality.fit_forest(x[~bad & ~half], x.min(0), x.max(0))
    limit = quality.calibrated(forest, x[half | bad], ~bad[half | bad], 0.995)
    s = forest.score(x)
    assert (s[bad] > limit).mean() > 0.95 and (s[~bad] <= limit).mean() > 0.99


def test_forest_isolates_what_is_far():
    r = np.random.default_rng(4)
    good, bad = r.normal(0, 1, (500, 4)), r.normal(9, 1, (60, 4))
    x = np.vstack([good, bad])
    forest = quality.fit_forest(good, x.min(0), x.max(0))
    limit = quality.calibrated(forest, x, np.arange(560) < 500, 0.99)
    s = forest.score(x)
    assert (s[500:] > limit).mean() > 0.95 and (s[:500] > limit).mean() < 0.02


def test_toxicity_equals_its_plain_form(spark):
    """Scores are the softmax over the mean of the n-grams' embeddings, long texts included."""
    r = random.Random(4)
    rows = [(k, " ".join(sentence(r, 30).lower() for _ in range(3)) + (" dreadful" * (1 + k % 4) if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table)
    assert model.embeddings.shape[1] == toxicity.DIM == 16 and len(model.buckets)
    of = {int(b): e.astype(float) for b, e in zip(model.buckets, model.embeddings)}

    def plain(text):
        bag = np.frombuffer(f" {text or ''} ".encode(), np.uint8)
        mean, n = np.zeros(toxicity.DIM), 0
        for _, bucket, inside in toxicity.gram_buckets(bag):
            for b in bucket[inside].tolist():
                mean, n = mean + of.get(b, 0), n + 1
        logit = mean / max(n, 1) @ (model.softmax[:, 1] - model.softmax[:, 0]).astype(float) + model.bias
        return 1 / (1 + math.exp(-logit))

    tests = [t for _, t, _ in rows[:12]] + [None, "", " \n", "a", "Dreadful, DREADFULLY", "dreadful " * 20_000]
    got = by_id(toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model))
    for k, t in enumerate(tests):
        assert math.isclose(got[k]["score"], plain(t), rel_tol=1e-4, abs_tol=1e-6), t


def test_toxicity_bounds(spark):
    """Many rows of one id count once, and the bound on entries leaves out whole rows."""
    table = spark.createDataFrame([(k % 20, f"word{k} dreadful" if k % 2 else f"word{k}", k % 2) for k in range(200)], "doc_id long, text string, toxic int")
    assert toxicity.labelled_bags(table, table, 4000, None).count() == 20
    assert isinstance(toxicity.fit(table, table, entries=100), toxicity.Model)


def test_toxicity_shares_subwords(spark, empty, tied):
    """Misspellings that no training row has are caught by what they share with those that one has."""
    r = random.Random(9)
    bad = ["dreadful", "horrible", "worthless"]

    def row(toxic, words_):
        w = [y for _ in range(8) for y in sentence(r, 6).lower().split(" ")]
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(words_))
        return " ".join(w)

    train = [(k, row(k % 3 == 0, bad), int(k % 3 == 0)) for k in range(400)]
    table = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table)
    test = [(k, row(k % 2 == 0, ["dreadfull", "horribles", "worthlesss"]), k % 2 == 0) for k in range(100)]
    got = by_id(toxicity.score(spark.createDataFrame([x[:2] for x in test], "doc_id long, text string"), model))
    assert np.mean([(got[k]["predicted"] == 1) == y for k, _, y in test]) > 0.9
    assert toxicity.score(empty, model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(tied, model).collect())
    nothing = toxicity.fit(table, table.where("toxic = 5"))
    assert toxicity.score(table, nothing).where("predicted = 1").count() == 0
    kept = toxicity.accepted(tied.withColumn("score", F.lit("x")), model)
    assert kept.columns == [*tied.columns, "score"]
