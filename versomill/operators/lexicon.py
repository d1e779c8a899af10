"""Word frequencies, and which words of a target text are left over from the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    words = docs.select(F.col(lang).alias("lang"), F.explode(X.lower_words(F.col(text))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def zipf_lexicon(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, word and zipf: log10 of the occurrences among a thousand million words."""
    counts = word_counts(docs, text, lang)
    totals = counts.groupBy(F.col("lang").alias("__lang")).agg(F.sum("n").alias("total"))  # a row a language, from the same shuffle
    return counts.join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("__lang"))).select("lang", "word", F.round(F.log10(F.col("n") * 1e9 / F.col("total")), 6).alias("zipf"))


def skeleton_index(lexicon: DataFrame) -> DataFrame:
    """lang, skel, word and zipf of words with at least one consonant."""
    return lexicon.select("lang", X.skeleton(F.col("word")).alias("skel"), "word", "zipf").where(F.col("skel") != "")


#: Words that are looked up by a broadcast because very many rows may hold them.
HOT_WORDS = 4096


def frequencies(words: DataFrame, lexicon: DataFrame, source: str, target: str) -> DataFrame:
    """w, s and t of each distinct word in lower case that either language has."""
    both = lexicon.where(F.col("lang").isin(source, target)).groupBy(F.lower("word").alias("w"))
    found = both.agg(F.coalesce(F.max(F.when(F.col("lang") == source, F.col("zipf"))), F.lit(0.0)).alias("s"), F.coalesce(F.max(F.when(F.col("lang") == target, F.col("zipf"))), F.lit(0.0)).alias("t"))
    return found if words is None else found.join(words.select(F.col("word").alias("w")).distinct(), "w", "left_semi")


def with_frequencies(tokens: DataFrame, lexicon: DataFrame, source: str, target: str, word: str = "word") -> DataFrame:
    """tokens plus s and t, the frequencies in both languages; 0 for unknown words.

    The lexicon's most frequent words, of which one may be in a large share of all rows,
    are broadcast; only other tokens go by a shuffle, and those that are done are spread
    over it by a number of their own.
    """
    known = frequencies(None, lexicon, source, target)
    hot = known.orderBy(F.desc(F.greatest("s", "t")), "w").limit(HOT_WORDS)
    low = F.lower(F.col(word))
    found = tokens.join(F.broadcast(hot.select(F.col("w").alias("__h"), F.col("s").alias("__hs"), F.col("t").alias("__ht"))), low == F.col("__h"), "left")
    spread = F.concat(F.lit("\x00"), F.pmod(F.monotonically_increasing_id(), F.lit(4099)).cast("string"))
    found = found.withColumn("__k", F.when(F.col("__h").isNull() & F.col(word).isNotNull(), low).otherwise(spread))
    found = found.join(known.select(F.col("w").alias("__k"), "s", "t"), "__k", "left")
    values = {"s": F.coalesce("__hs", "s", F.lit(0.0)), "t": F.coalesce("__ht", "t", F.lit(0.0))}
    return found.select(*tokens.columns, *[v.alias(k) for k, v in values.items()])


def is_source_word(token: Column, s: Column, t: Column, source: str = "en", target: str = "tr") -> Column:
    """Whether a token is a word of the source language and not of the target's."""
    low = F.regexp_replace(F.lower(token), "^['’]+|['’]+$", "")
    letters = C.TARGET_LETTERS.get(target, "")
    never = (F.length(low) < 2) | ~low.rlike("^[a-z]+$") | X.is_roman(low) | low.isin(C.TARGET_WORDS.get(target, [""]))
    if letters:
        never = never | token.rlike(f"[{letters}]")
    capitals = (F.upper(token) == token) & (F.lower(token) != token) & (F.length(token) >= 3)
    first = F.substring(token, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    both = (s < SOURCE_LEAST) | ((t >= 3.8) & (s - t < 1.5))
    always = low.isin(C.FUNCTION_WORDS) if source == "en" else F.lit(False)
    return F.when(never, False).when(always, True).when(capitals, (s >= 4.0) & (s - t >= 1.5)).when(capital, False).when(both, False).otherwise(s - t >= 0.8)


#: The least frequencies with which a word can be the source's (but for function words), and the target's.
SOURCE_LEAST, TARGET_LEAST = 3.2, 2.5


def source_forms(lexicon: DataFrame, source: str, target: str) -> DataFrame:
    """Words of which a form is a source word: w, and whether they are in lower case (plain), in capitals, with a capital first (title).

    Frequencies are out of a thousand million words, so that at most 10 ** (9 - SOURCE_LEAST),
    about 631,000, reach the least one, however large the texts: these can be broadcast.
    """
    always = C.FUNCTION_WORDS if source == "en" else []
    # no condition on words alone: it would go down to one of two equal counts, which then no longer share a shuffle
    known = frequencies(None, lexicon, source, target).where(F.when(F.col("w").isin(always), False).otherwise(F.col("s") >= SOURCE_LEAST))
    known = known.withColumn("w", F.coalesce("w", F.lit("")))
    named = lexicon.sparkSession.createDataFrame([(w, 0.0, 0.0) for w in always], "w string, s double, t double")
    forms = {"plain": F.col("w"), "capitals": F.upper("w"), "title": F.initcap("w")}
    found = known.unionByName(named).select("w", *[is_source_word(x, F.col("s"), F.col("t"), source, target).alias(k) for k, x in forms.items()])
    return found.where("plain or capitals or title")


def source_tokens(tokens: DataFrame, lexicon: DataFrame, source: str, target: str, word: str = "word") -> DataFrame:
    """The tokens that ``is_source_word`` takes, for words of letters only, as ``leftover_tokens`` gives them.

    A verdict depends on the word in lower case and on which letters are capitals, so it is
    made once a word, and tokens look it up without a shuffle.
    """
    forms = source_forms(lexicon, source, target).select(F.col("w").alias("__w"), F.struct("plain", "capitals", "title").alias("__is"))
    token, first = F.col(word), F.substring(word, 1, 1)
    capitals = (F.upper(token) == token) & (F.lower(token) != token) & (F.length(token) >= 3)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    verdict = F.when(token == F.col("__w"), F.col("__is.plain")).when(capitals, F.col("__is.capitals")).when(capital, F.col("__is.title")).otherwise(F.col("__is.plain"))
    return tokens.join(F.broadcast(forms), F.lower(token) == F.col("__w")).where(verdict).select(*tokens.columns)


def target_words(lexicon: DataFrame, source: str, target: str) -> DataFrame:
    """w: words in lower case that are frequent in the target language and no source words; by their frequency at most 3.2 million."""
    known = frequencies(None, lexicon, source, target).where(F.col("t") >= TARGET_LEAST)
    return known.where(~is_source_word(F.col("w"), F.col("s"), F.col("t"), source, target)).select(F.coalesce("w", F.lit("")).alias("w"))


def leftover_tokens(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, pos and word of every word of a target text, addresses left out."""
    found = X.apostrophe_words(X.without_addresses(F.coalesce(F.col(text), F.lit(""))))
    return rows.select(*keys, F.posexplode(found).alias("pos", "word"))


def source_facts(rows: DataFrame, text: str) -> DataFrame:
    """Words of the source text with whether they occur in lower case, and how often capitalised within a sentence."""
    words = rows.select(F.explode(X.sentences_for_names(F.col(text))).alias("s")).select(F.posexplode(F.regexp_extract_all("s", F.lit(r"(\p{L}+)"), 1)).alias("i", "w"))
    low = F.lower("w") == F.col("w")
    return words.groupBy(F.lower("w").alias("word")).agg(F.max(low).alias("seen_lower"), F.count_if(~low & (F.col("i") > 0)).alias("n_capitals"))


def compounds(words: DataFrame, lexicon: DataFrame, lang: str, word: str = "word") -> DataFrame:
    """Words that fall into two ordinary ones: five letters or more, then three or more that are no name's ending."""
    ordinary = lexicon.where((F.col("lang") == lang) & (F.col("zipf") >= 3.0)).select(F.col("word").alias("part"))
    low = words.select(F.lower(word).alias("w")).distinct().where(F.length("w") >= 8)
    cuts = low.select("w", F.explode(F.sequence(F.lit(5), F.length("w") - 3)).alias("i"))
    cuts = cuts.select("w", F.expr("substring(w, 1, i)").alias("head"), F.expr("substring(w, i + 1)").alias("tail")).where(~F.col("tail").isin(C.NAME_ENDINGS))
    cuts = cuts.join(ordinary.withColumnRenamed("part", "head"), "head", "left_semi").join(ordinary.withColumnRenamed("part", "tail"), "tail", "left_semi")
    return cuts.select(F.col("w").alias("word")).distinct()


def capitalised_common_nouns(tokens: DataFrame, facts: DataFrame, lexicon: DataFrame, source: str, target: str) -> DataFrame:
    """Capitalised tokens that are ordinary words of the source text rather than names."""
    first = F.substring("word", 1, 1)
    found = tokens.where((F.length("word") >= 4) & (F.upper("word") != F.col("word")) & (F.upper(first) == first) & (F.lower(first) != first))
    found = found.join(facts.withColumnRenamed("word", "low"), F.lower(found["word"]) == F.col("low")).drop("low")
    found = with_frequencies(found, lexicon, source, target).where("t < 2.5")
    parts = compounds(found, lexicon, source).withColumnRenamed("word", "compound")
    found = found.join(parts, F.lower(found["word"]) == F.col("compound"), "left")
    return found.where(F.col("seen_lower") | ((F.col("n_capitals") <= 1) & F.col("compound").isNotNull())).drop("compound")


def stretched_candidates(parts: Column) -> Column:
    """How a stretched word such as so-o-o might be spelled: joined, then with long runs as two letters, then as one."""
    joined = F.array_join(parts, "")
    return F.array(joined, F.regexp_replace(joined, r"(?i)(.)\1{2,}", "$1$1"), F.regexp_replace(joined, r"(?i)(.)\1+", "$1"))


#: The most frequent words among which the nearest one to a stretched word is looked for.
INDEX_WORDS = 40_000


def unstretched(words: DataFrame, lexicon: DataFrame, lang: str, word: str = "word", vocabulary: DataFrame | None = None, *keys: str) -> DataFrame:
    """keys, word and fixed: the word without its stretch, in its case; itself if it is none.

    Parts stand between dashes.  A word is stretched if letters at a border are equal or
    a part is no word; words of ordinary parts and stammers stay as they are.  Of the
    spellings (joined, long runs as two letters, runs as one) the first that is an ordinary
    word is taken; for a stretched word without any, the word that is nearest.
    ``vocabulary`` (keys, word) has the words of the text around.
    """
    known = lexicon.where(F.col("lang") == lang).select(F.lower("word").alias("__w"), F.col("zipf").alias("__z"))
    every = words.select(*keys, F.col(word).alias("word")).distinct()
    base = every.select("word").distinct().withColumn("parts", F.filter(F.split("word", "[-—–]+"), lambda p: p != ""))
    base = base.where((F.size("parts") >= 2) & ~X.one_stammer(F.col("parts")))
    each = base.select("word", F.explode("parts").alias("part")).join(known, F.lower("part") == F.col("__w"), "left")
    weak = each.groupBy("word").agg(F.min(F.coalesce("__z", F.lit(0.0))).alias("weakest"))
    i = F.sequence(F.lit(0), F.size("parts") - 2)
    touching = F.exists(i, lambda k: F.lower(F.substring(F.reverse(F.col("parts")[k]), 1, 1)) == F.lower(F.substring(F.col("parts")[k + 1], 1, 1)))
    base = base.join(weak, "word").withColumn("stretched", touching | (F.col("weakest") < 2.0)).where("stretched or weakest < 3.0")
    base = base.withColumn("cands", stretched_candidates(F.col("parts")))
    tried = base.select("word", F.posexplode("cands").alias("k", "cand")).join(known.where("__z >= 3.0"), F.lower("cand") == F.col("__w"))
    best = tried.groupBy("word").agg(F.min_by(F.lower("cand"), "k").alias("best"))
    found = every.join(base, "word").join(best, "word", "left")
    near = nearest_word(found.where("best is null and stretched"), lexicon, lang, vocabulary, *keys)
    found = found.select(*keys, "word", "best").join(near.withColumnRenamed("fixed", "near"), [*keys, "word"], "left")
    found = found.select(*keys, "word", F.coalesce("best", "near").alias("best")).where("best is not null")
    return every.join(found, [*keys, "word"], "left").select(*keys, "word", F.coalesce(X.restore_case(F.col("word"), F.col("best")), F.col("word")).alias("fixed"))


def nearest_word(words: DataFrame, lexicon: DataFrame, lang: str, vocabulary: DataFrame | None = None, *keys: str) -> DataFrame:
    """keys, word and fixed: of the words with the same consonants and first letter the one that is most alike, frequent and known to the text, if it is alike enough.

    ``words`` may have cands, an array of spellings of which the one most alike counts.
    """
    from .quality import sequence_ratio

    common = lexicon.where(F.col("lang") == lang).orderBy(F.desc("zipf"), "word").limit(INDEX_WORDS)
    index = skeleton_index(common).select("skel", F.col("word").alias("cand"), "zipf")
    words = words if "cands" in words.columns else words.withColumn("cands", F.array("word"))
    rows = words.select(*keys, "word", "cands", X.skeleton(F.col("cands")[0]).alias("skel"))
    found = rows.join(index, "skel").where(F.lower(F.substring("word", 1, 1)) == F.substring("cand", 1, 1))
    if vocabulary is not None:
        own = vocabulary.select(*keys, F.col("word").alias("cand"), F.lit(1.0).alias("own")).distinct()
        found = found.join(own, [*keys, "cand"], "left")
    else:
        found = found.withColumn("own", F.lit(0.0))
    each = found.select(*keys, "word", "cand", "zipf", "own", F.explode("cands").alias("spelling"))
    each = each.withColumn("ratio", sequence_ratio(F.split(F.lower("spelling"), ""), F.split("cand", "")))
    each = each.groupBy(*keys, "word", "cand").agg(F.max("ratio").alias("ratio"), F.max("zipf").alias("zipf"), F.max("own").alias("own"))
    score = F.col("ratio") + 0.15 * F.col("zipf") + F.coalesce("own", F.lit(0.0))
    best = each.groupBy(*keys, "word").agg(F.max_by(F.struct("cand", "ratio"), F.struct(score, F.col("cand"))).alias("b"))
    return best.where("b.ratio >= 0.6").select(*keys, "word", F.col("b.cand").alias("fixed"))


def leftovers(tokens: DataFrame, lexicon: DataFrame, source: str, target: str, facts: DataFrame | None = None) -> DataFrame:
    """tokens that are source words, or, with facts of the source text, capitalised common nouns of it."""
    found = with_frequencies(tokens, lexicon, source, target)
    words = found.where(is_source_word(F.col("word"), F.col("s"), F.col("t"), source, target)).select(*tokens.columns)
    if facts is None:
        return words
    nouns = capitalised_common_nouns(tokens, facts, lexicon, source, target).select(*tokens.columns)
    return words.unionByName(nouns).distinct()


def joined_over_break(pairs: DataFrame, lexicon: DataFrame, lang: str) -> DataFrame:
    """pairs a, b at a line break, plus joined: whether they are one word that was broken."""
    known = lexicon.where(F.col("lang") == lang).select("word", "zipf")

    def freq(df, column, name):
        return df.join(known.select(F.col("word").alias("__w"), F.col("zipf").alias(name)), F.lower(column) == F.col("__w"), "left").drop("__w")

    found = freq(freq(freq(pairs, F.col("a"), "za"), F.col("b"), "zb"), F.concat("a", "b"), "zab")
    za, zb, zab = (F.coalesce(x, F.lit(0.0)) for x in ("za", "zb", "zab"))
    return found.withColumn("joined", (zab >= 1.5) & (zb < 1.5) & ((F.length("a") <= 2) | (za < 4.5))).drop("za", "zb", "zab")
