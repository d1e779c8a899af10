"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, hmm, licenses, neardup, quality, substring, tokencount, tokenfile, toxicity
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), keep=crc_mod("doc_id", 3) != 1)
    found = toxicity.score(docs, model, threshold=0.7)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).alias("first_word"),
        F.get("places", F.size("places") - 1).alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.through_files(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(_table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "doc.text", "n_sentences", "n_removed")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=13, percent=5)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), limit=4096)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.score(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that do not depend on the method's own labels."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that the model does not enter; the score to four places."""
    found = op9_lm_scoring(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that the forest does not enter."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    dealt = (op1_toxicity, op2_bpe_round_trip, op3_license_scan, op4_token_files, op5_near_duplicates, op6_substring_dedup, op7_decontamination, op8_token_counts, op9_lm_scoring, op10_quality_rules)
    return {f.__name__: f for f in (*dealt, license_base, lm_base, quality_base)}


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {_ALNUM_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_ALNUM_WORDS} as w from benchmark where item_id is not null),
bw as (select distinct item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
       from (select item, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
       from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select r, i, dw.k, item from dw join bw on dw.g = bw.g and dw.k = bw.k),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from h) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (r) left join t using (r)
"""


_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
#: The order of documents with equal ids is not SQL's to know; ids are unique in the tables.
_NEAR_DUPLICATES = f"""
with recursive d as materialized (select doc_id, regexp_extract_all({_ASCII_LOWER}, '{_WORD}+') as w from documents),
s as materialized (select distinct doc_id, case when len(w) >= 3 then array_to_string(w[i : i + 2], ' ') else array_to_string(w, ' ') end as g
                   from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
met as (select a.doc_id as x, b.doc_id as y, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as materialized (select x, y from met join n p on p.doc_id = x join n q on q.doc_id = y where 100 * m >= 85 * (p.n + q.n - m)),
edge as materialized (select x, y from link union select y, x from link),
reach(x, y) as (select x, y from edge union select r.x, e.y from reach r join edge e on r.y = e.x),
least as (select x, least(x, min(y)) as c from reach group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join least on least.x = d.doc_id
"""

_SUBSTRING = f"""
with t as materialized (select doc_id, text, regexp_extract_all(text, '{_WORD}+{_WS}*') as p from documents),
w as materialized (select doc_id, i, p[i] as piece, rtrim(p[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as word, i = len(p) as final
                   from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from t)),
e as (select *, final or contains(substr(piece, length(word) + 1), chr(10)) or regexp_matches(word, '[.!?]$|[.!?]["'')\\]}}]$') as stop from w),
f as (select *, coalesce(sum(stop::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as natural_no from e),
g as (select *, stop or row_number() over (partition by doc_id, natural_no order by i) % 20 = 0 as ends from f),
h as materialized (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s from g),
u as materialized (select doc_id, s, min(i) as a, max(i) as z, string_agg(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' order by i) as words from h group by doc_id, s),
pairs as (select x.doc_id, x.s as lo, min(y.s) as hi from u x join u y on x.doc_id = y.doc_id and y.s >= x.s and y.s < x.s + 25 and y.z - x.a + 1 >= 25 group by x.doc_id, x.s
          union select y.doc_id, max(x.s) as lo, y.s as hi from u x join u y on x.doc_id = y.doc_id and y.s >= x.s and y.s < x.s + 25 and y.z - x.a + 1 >= 25 group by y.doc_id, y.s),
k as materialized (select r.doc_id, lo, hi, string_agg(words, ' ' order by u.s) as key from pairs r join u on u.doc_id = r.doc_id and u.s between lo and hi group by r.doc_id, lo, hi),
o as (select doc_id, lo, hi, row_number() over (partition by key order by doc_id, lo, hi) as nth from k),
gone as materialized (select distinct o.doc_id, u.s from o join u on u.doc_id = o.doc_id and u.s between lo and hi where nth > 1),
cut as (select h.doc_id, string_agg(piece, '' order by i) filter (where gone.s is null) as rest, count(distinct h.s) as n_sentences, count(distinct gone.s) as n_removed
        from h left join gone on gone.doc_id = h.doc_id and gone.s = h.s group by h.doc_id)
select t.doc_id, case when cut.doc_id is null then text else regexp_extract(text, '^{_WS}*') || coalesce(rest, '') end as text,
       coalesce(n_sentences, 0) as n_sentences, coalesce(n_removed, 0) as n_removed
from t left join cut using (doc_id)
"""

_LICENSE_BASE = f"""
with d as materialized (select doc_id, {_ALNUM_WORDS} as w from documents),
t(label, p) as (values ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
h as (select doc_id, i, label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) x join t on x.w[i : i + len(p) - 1] = p)
select d.doc_id, cast(len(any_value(w)) as bigint) as n_words, count(i) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word,
       coalesce(array_to_string(list_sort(list(distinct label) filter (where label is not null)), ','), '') as base_labels
from d left join h using (doc_id) group by d.doc_id
"""

#: DuckDB has no crc32: a table of 256 entries is made from its polynomial, and ids go through it a character at a time.
_STEP = "xor({0} >> 1, ({0} & 1) * 3988292384)"


def _crc_of_byte(c: str) -> str:
    """One byte's eight steps, as nested lateral columns."""
    inner = f"select {c} as c0"
    for k in range(8):
        inner = f"select {_STEP.format(f'c{k}')} as c{k + 1} from ({inner})"
    return f"(select c8 from ({inner}))"


_LM_BASE = f"""
with recursive bytes as materialized (select b, {_crc_of_byte("b")} as t from (select unnest(range(0, 256)) as b)),
ids as materialized (select distinct doc_id, cast(doc_id as varchar) as x from documents),
crc(doc_id, x, k, c) as (select doc_id, x, 0, 4294967295::bigint from ids
    union all select doc_id, x, k + 1, xor(c >> 8, t) from crc join bytes on b = xor(c, ascii(substr(x, k + 1, 1))::bigint) & 255 where k < length(x)),
held as materialized (select doc_id, xor(c, 4294967295::bigint) % 7 = 2 as held_out from crc where k = length(x)),
w as materialized (select doc_id, unnest(list_append(regexp_extract_all({_ASCII_LOWER}, '{_WORD}+'), ' ')) as word from documents),
m as materialized (select doc_id, word, count(*) as k from w group by all),
c as materialized (select word, sum(k) as c from m join held using (doc_id) where not held_out group by word),
n as (select sum(c) as n, count(*) as v from c)
select m.doc_id, any_value(held_out) as held_out, cast(sum(k) as bigint) as n_tokens, cast(sum(case when c.c is null then 0 else k end) as bigint) as n_known,
       cast(any_value(n.n) as bigint) as train_tokens, round(sum(k * log10((coalesce(c.c, 0) + 1) / (n.n + n.v + 1.0))), 4) as base_score
from m join held using (doc_id) left join c using (word), n group by m.doc_id
"""

_QUALITY_BASE = f"""
with d as materialized (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
l as (select doc_id, line, count(*) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{_WORD}') group by all),
dup as (select doc_id, sum(k - 1) as n_dup_lines from l group by doc_id),
g as materialized (select doc_id, i, w[i : i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, i from g join (select doc_id, g from g group by all having count(*) > 1) using (doc_id, g)),
rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
       cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
       cast(coalesce(n, 0) as bigint) as n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
from d left join dup using (doc_id) left join rep using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_duplicates": _NEAR_DUPLICATES,
        "op6_substring_dedup": _SUBSTRING,
        "op7_decontamination": _DECONTAMINATION,
        "license_base": _LICENSE_BASE,
        "lm_base": _LM_BASE,
        "quality_base": _QUALITY_BASE,
    }
