"""Words left over: verdicts made once a word, tokens that are not shuffled, addresses found in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from versomill.functions import text as X
from versomill.operators import lexicon, quality
from versomill.plans import catalog

ADDRESS = r"https?://\S+|www\.\S+|\S+@\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|edu|gov|io)\b\S*"


def test_addresses_as_by_the_plain_pattern(spark):
    draw = random.Random(5)
    parts = ["a", "b-", "é", "É", ".", "@", "@@", " ", "\n", " ", "www.", "http://", "https://", ".com", ".io", ".org.", "ionic", ",", "(", "_", "-", "'s", "7"]
    texts = ["", " ", "a@b", "@a", "a@", "x@ y.com", "see(www.a b", ".com", "a.com.", "a.b.comx", "a.b.com-x y"] + ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    c = F.col("t")
    plain = F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+(?:['’]\p{L}+)?)"), 1), lambda w: F.split(w, "['’]")[0])
    found = rows.select("t", X.without_addresses(c).alias("got"), F.regexp_replace(c, ADDRESS, " ").alias("want"), X.apostrophe_words(c).alias("words"), plain.alias("plain")).collect()
    assert [r for r in found if r["got"] != r["want"] or r["words"] != r["plain"]] == []


def test_long_runs_without_spaces(spark):
    """One pass over each run; all starts and ends of a run took its length squared."""
    rows = spark.createDataFrame([("a" * 300_000,), ("a" * 300_000 + "!b.com c",)], "t string")
    assert [len(r[0]) for r in rows.select(X.without_addresses(F.col("t"))).collect()] == [300_000, 300_001 + 3]


@pytest.mark.parametrize("target", ["tr", "de"])
def test_verdicts_of_tokens(spark, target):
    words = ["the", "on", "her", "house", "rug", "mix", "garten", "ab", "a", "kelvin", "şey", "i", "all", "nation", "none"]
    forms = [y for x in words for y in (x, x.upper(), x.title(), x[:1] + x[1:].upper(), x[:-1] + x[-1:].upper())] + ["Kelvin", "KELVIN", "İN", "ǅab", "house"]
    values = [0.0, 2.4, 2.5, 3.1, 3.2, 3.9, 4.0, 5.5, 7.0]
    draw = random.Random(7)
    for _ in range(4):
        known = [(lang, w, draw.choice(values)) for lang in ("en", target, "fr") for w in words if draw.random() < 0.8] + [(target, None, 6.0)]
        lex = spark.createDataFrame(known, "lang string, word string, zipf double")
        tokens = spark.createDataFrame(list(enumerate(forms)), "k long, word string")
        each = lexicon.with_frequencies(tokens, lex, "en", target)
        is_source = lexicon.is_source_word(F.col("word"), F.col("s"), F.col("t"), "en", target)
        want = sorted(r["k"] for r in each.where(is_source).collect())
        assert sorted(r["k"] for r in lexicon.source_tokens(tokens, lex, "en", target).collect()) == want
        fine = F.col("word").rlike(r"^\p{Lu}") | (F.length("word") <= 2) | ((F.col("t") >= 2.5) & ~is_source)
        fine = fine | F.col("word").rlike("[çğıöşüÇĞİÖŞÜ]") if target == "tr" else fine
        want = {r["k"]: float(r["f"]) for r in each.select("k", fine.alias("f")).collect()}
        assert {r["k"]: r["share"] for r in quality.target_share(tokens, lex, "word", "en", target, "k").collect()} == want


@pytest.mark.parametrize("name", ["leftover_words", "source_runs", "target_share"])
def test_tokens_are_not_shuffled_for_their_frequencies(spark, name):
    """Neither a join by a shuffle, whatever the sizes, nor two counts of the words."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        found.write.format("noop").mode("overwrite").save()
        found.count()
        plan = found._jdf.queryExecution()
        assert "SortMergeJoin" not in plan.executedPlan().toString() and "ShuffledHashJoin" not in plan.executedPlan().toString()
        counts = [x for x in plan.sparkPlan().toString().split("\n") if "Scan parquet" in x and "text" in x]
        assert len(counts) == 3 and sum("IN (de,en)" in x or "IN (en,de)" in x for x in counts) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
