"""Text functions over columns, all run by Spark itself."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: White space of both Java's and RE2's \s, and the no-break space.
SPACE = r"[\s\x{00A0}]"
WORD = r"\p{L}+"


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of any Unicode white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def collapse_simple(c: Column) -> Column:
    """The same for ASCII white space and the no-break space only, as other engines can express it."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_known(c: Column) -> Column:
    """The entities that pages use; the ampersand last, so that no entity arises anew."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, r"<[^>]*>", by)


def plain_placeholders(c: Column) -> Column:
    """Plain text of a segment: empty elements become a space, pairs vanish."""
    c = F.regexp_replace(c, r"(?i)<\s*x\d+\s*/\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<\s*/?\s*g\d+\s*>", "")
    return unescape_known(collapse(c))


def plain_spaced(c: Column) -> Column:
    """Plain text for quality rules: every placeholder becomes a space."""
    return F.trim(unescape_known(collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"</?g\d+>|<x\d+/>", " "))))


def has_markup(c: Column) -> Column:
    """Whether an encoded text has placeholders."""
    return c.rlike(r"</?g\d+>|<x\d+/>")


def local_name(c: Column) -> Column:
    return F.lower(F.substring_index(c, "}", -1))


def lower_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(" + WORD + ")"), 1)


def apostrophe_words(c: Column) -> Column:
    """Words without the suffix that follows an apostrophe."""
    return F.regexp_extract_all(c, F.lit(r"(\p{L}+)(?:['’]\p{L}+)?"), 1)


def sentences_for_names(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?\"“”])\s+")


def sentences(c: Column) -> Column:
    """Cut after . ! ? ; : where a capital, a quote or a bracket follows."""
    return F.filter(F.split(c, r"(?<=[.!?;:])\s+(?=[\"“‘'(A-Z])"), lambda x: F.trim(x) != "")


def sentences_any(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?;])\s+")


def without_addresses(c: Column) -> Column:
    """URLs, e-mail addresses and host names become a space.

    Each takes the rest of its run of signs, so that one with an @ begins where the run does.
    Texts without a sign of any are not gone through.
    """
    ends = ("com", "org", "net", "edu", "gov", "io")
    some = reduce(or_, [F.contains(c, F.lit(x)) for x in ("@", "://", "www.", *("." + x for x in ends))])
    return F.when(some, F.regexp_replace(c, rf"https?://\S+|www\.\S+|(?<!\S)\S[^\s@]*+@\S+|\b[\w-]++(?:\.[\w-]++)*\.(?:{'|'.join(ends)})\b\S*", " ")).otherwise(c)


def is_roman(c: Column) -> Column:
    return c.rlike("^[ivxlcdm]+$")


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def code_like(c: Column) -> Column:
    return F.regexp_count(c, F.lit(C.CODE_LIKE)) >= 2


def skeleton(c: Column) -> Column:
    """Consonants of a word, equal neighbours as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[aeiouy]", ""), r"(.)\1+", "$1")


def repeats_thrice(words: Column) -> Column:
    """Whether three equal words follow one another; words hold no spaces."""
    return F.array_join(words, " ").rlike(r"(?:^| )([^ ]+) \1 \1(?: |$)")


def one_stammer(parts: Column) -> Column:
    """Whether all parts are the same word."""
    return F.size(F.array_distinct(F.transform(parts, F.lower))) == 1


def length_ratio(source: Column, target: Column) -> Column:
    return F.length(target) / F.greatest(F.lit(1), F.length(source))


def stray_count(c: Column, source: str = "en") -> Column:
    pattern = C.STRAY_WORDS.get(source)
    return F.regexp_count(c, F.lit(pattern)) if pattern else F.lit(0)


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[0-9;?]*[A-Za-z]", "")


def rate_limited(c: Column) -> Column:
    return c.rlike(r"(?i)rate.?limit|too many requests|\b429\b|quota")


def slug(c: Column) -> Column:
    """Anchor of a heading: tags and signs go, spaces become hyphens."""
    c = F.lower(F.trim(strip_tags(c)))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\p{P}\p{Z}\-_ ]", "")
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\- ]", ""), " ", "-")


def language_name(c: Column) -> Column:
    base = F.lower(F.split(c, "-")[0])
    names = F.create_map(*[F.lit(x) for pair in C.LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, base), c)


def restore_case(original: Column, word: Column, target: str = "") -> Column:
    """The word in the original's case: all capitals, a capital first, or as it is."""
    dotted = F.replace(word, F.lit("i"), F.lit("İ")) if target == "tr" else word
    first = F.concat(F.upper(F.substring(dotted, 1, 1)), F.substring(word, 2, 1_000_000))
    capital = F.substring(original, 1, 1)
    return F.when((F.length(original) > 1) & (F.upper(original) == original) & (F.lower(original) != original), F.upper(dotted)).when(F.upper(capital) == capital, first).otherwise(word)


def keep_outer_space(original: Column, text: Column) -> Column:
    return F.concat(F.regexp_extract(original, r"^(\s*)", 1), F.trim(text), F.regexp_extract(original, r"(\s*)$", 1))


def ranges(c: Column) -> Column:
    """``1-3,5`` as a sorted array of numbers."""
    parts = F.filter(F.split(c, r"\s*,\s*"), lambda p: p != "")
    each = F.transform(parts, lambda p: F.when(p.contains("-"), F.sequence(F.split(p, "-")[0].cast("int"), F.split(p, "-")[1].cast("int"))).otherwise(F.array(p.cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def segment_frames(c: Column) -> Column:
    """Answers of the form <seg id="1">text</seg> as an array of (id, text)."""
    ids = F.regexp_extract_all(c, F.lit(C.SEGMENT_FRAME), 1)
    texts = F.regexp_extract_all(c, F.lit(C.SEGMENT_FRAME), 2)
    return F.zip_with(ids, texts, lambda i, t: F.struct(i.cast("int").alias("id"), strip(t).alias("text")))


def glossary_lines(c: Column) -> Column:
    """Lines ``term => target`` of the glossary blocks, as an array of (term, target)."""
    blocks = F.array_join(F.regexp_extract_all(c, F.lit(C.GLOSSARY_BLOCK), 1), "\n")
    lines = F.filter(F.split(blocks, "\n"), lambda x: x.contains("=>"))
    edge = r"^[\s\-*•\"']+|[\s\-*•\"']+$"
    return F.transform(lines, lambda x: F.struct(F.regexp_replace(F.split(x, "=>", 2)[0], edge, "").alias("term"), F.regexp_replace(F.split(x, "=>", 2)[1], edge, "").alias("target")))


def rewrap(source: Column, source_plain: Column, result: Column) -> Column:
    """Drops one pair of quotes that the source has not, then puts the source's single outer element around a plain result."""
    quotes = '["“”«»]'
    counted = F.regexp_count(result, F.lit('["“”]'))
    quoted = (F.length(F.trim(result)) > 2) & F.trim(result).rlike(f"(?s)^{quotes}.*{quotes}$") & ~source_plain.rlike(f"^{quotes}") & (counted == 2)
    bare = F.when(quoted, F.trim(F.regexp_replace(F.trim(result), f"(?s)^{quotes}(.*){quotes}$", "$1"))).otherwise(result)
    inner = F.regexp_extract(source, C.OUTER_ELEMENT, 2)
    number = F.regexp_extract(source, C.OUTER_ELEMENT, 1)
    single = source.rlike(C.OUTER_ELEMENT) & ~inner.contains("<")
    return F.when(bare.isNull() | (bare == ""), bare).when(bare.rlike(r"(?i)<\s*/?\s*[gx]\d+\s*/?\s*>"), bare).when(single, F.concat(F.lit("<g"), number, F.lit(">"), bare, F.lit("</g"), number, F.lit(">"))).otherwise(bare)


def cache_key(engine: Column, model: Column, stage: Column, source_lang: Column, target_lang: Column, text: Column) -> Column:
    parts = [F.coalesce(x, F.lit("")) for x in (engine, model, stage, source_lang, target_lang, text)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def file_id(content: Column, target: Column) -> Column:
    return F.concat(F.substring(F.sha1(content), 1, 16), F.lit(":"), target)


def prompt_id(prompt: Column) -> Column:
    return F.substring(F.sha1(prompt.cast("binary")), 1, 10)


def wait_seconds(attempt: Column, limited: Column) -> Column:
    """Pause after a failed attempt, counted from 0."""
    return F.when(limited, F.least(F.lit(90.0), 15 * F.pow(F.lit(2.0), attempt))).otherwise(2 * F.pow(F.lit(2.0), attempt))


def untranslated(translation: Column) -> Column:
    return translation.isNull() | (translation == "")


def cache_stage(is_llm: Column, polish: Column) -> Column:
    return F.when(~is_llm, "mt").when(polish, "llm-polished").otherwise("llm")


def engine_label(name: Column, model: Column) -> Column:
    """name, or the model where that names its engine, or name/model."""
    return F.when(model.isNull() | (model == ""), name).when(F.startswith(model, F.concat(name, F.lit("/"))), model).otherwise(F.concat_ws("/", name, model))
