"""A run: cache, batches, engines, results and log, as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from . import cache as K
from . import engines as E
from . import packing

_RESULT = "doc_index long, seg_no long, result string, result_engine string, log string"


def run_batches(batched: DataFrame, names: list[str], retries: int = 3, pause: bool = True, src: str = "en", tgt: str = "tr") -> DataFrame:
    """doc_index, seg_no, result and engine of every segment, and on each batch's first row its call log as JSON.

    One group is one batch, which is bounded by its packing; engines are made anew on
    the executors.
    """
    makers = [E.maker(n, src, tgt) for n in names]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("local_id")
        chain = [m() for m in makers]
        sleep = {} if pause else {"sleep": lambda s: None}
        found, log = E.through_chain(chain, pdf["source"].tolist(), retries, plain=pdf["plain"].tolist(), **sleep)
        return pd.DataFrame({"doc_index": pdf["doc_index"].to_numpy(), "seg_no": pdf["seg_no"].to_numpy(), "result": [r for r, _ in found], "result_engine": [e for _, e in found], "log": [json.dumps(log)] + [None] * (len(pdf) - 1)})

    rows = batched.select("doc_index", "seg_no", "source", "plain", "batch_no", "local_id")
    return rows.groupBy("doc_index", "batch_no").applyInPandas(one, _RESULT)


def call_log(results: DataFrame) -> DataFrame:
    schema = "array<struct<engine: string, attempt: int, ok: boolean, error_class: string, seconds: double>>"
    return results.where("log is not null").select("doc_index", F.inline(F.from_json("log", schema)))


def stage_of(engine: E.Engine, polish: bool) -> str:
    return ("llm-polished" if polish else "llm") if engine.is_llm else "mt"


def cache_rows(done: DataFrame, names: list[str], src: str, tgt: str, model: str | None = None, polish: bool = False) -> DataFrame:
    """Cache rows of what engines gave in a run, each under its own engine, stage and, for the first engine, model."""
    model_of, stage_of_ = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in names:
        e = E.make(n)
        here = F.col("engine") == e.name
        stage_of_ = F.when(here, stage_of(e, polish)).otherwise(stage_of_)
        model_of = F.when(here, F.lit(model if n == names[0] else None).cast("string")).otherwise(model_of)
    kept = done.where(~F.col("hit") & F.col("translation").isNotNull() & (F.col("translation") != "")).withColumns({"stage": stage_of_, "model": model_of})
    key = X.cache_key(F.col("engine"), F.col("model"), F.col("stage"), F.lit(src), F.lit(tgt), F.col("source"))
    return kept.select(key.alias("key"), "engine", "model", "stage", F.lit(src).alias("src"), F.lit(tgt).alias("tgt"), "source", F.col("translation").alias("result"), F.unix_timestamp().cast("double").alias("created"))


def translate(segments: DataFrame, names: list[str], cache: DataFrame | None, src: str, tgt: str, model: str | None = None, polish: bool = False, retries: int = 3, pause: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments with translation, engine and hit; new cache rows; the call log.

    Only the first engine's cache is read.  A translator's segments are looked up one
    by one; an LLM's chunk is taken from the cache only if all of it is there.
    """
    primary = E.make(names[0])
    limit, items = (C.LLM_CHUNK_CHARS, None) if primary.is_llm else (primary.max_chars, C.MT_BATCH_ITEMS)
    keyed = K.lookup(K.keyed(segments, primary.name, model, stage_of(primary, polish), src, tgt), cache)
    if primary.is_llm:
        chunks = packing.greedy_batches(keyed, "doc_index", "seg_no", "source", limit)
        whole = K.whole_chunks(chunks, "doc_index", "batch_no").select("doc_index", "batch_no", "from_cache")
        batched = chunks.join(whole, ["doc_index", "batch_no"]).withColumn("hit", F.col("from_cache")).drop("from_cache")
        todo = batched.where(~F.col("hit"))
    else:
        batched = keyed
        todo = packing.greedy_batches(keyed.where(~F.col("hit")), "doc_index", "seg_no", "source", limit, items)
    results = run_batches(todo, names, retries, pause, src, tgt)
    fresh = results.select("doc_index", "seg_no", F.col("result").alias("__new"), F.col("result_engine").alias("__by"))
    joined = batched.join(fresh, ["doc_index", "seg_no"], "left")
    found = F.when(F.col("hit"), F.col("result")).otherwise(F.col("__new"))
    done = joined.withColumn("translation", X.rewrap(F.col("source"), F.col("plain"), found)).withColumn("engine", F.when(F.col("hit"), F.lit(primary.name)).otherwise(F.col("__by")))
    done = done.select(*segments.columns, "translation", "engine", "hit")
    return done, cache_rows(done, names, src, tgt, model, polish), call_log(results)


def polished(drafts: DataFrame, revised: DataFrame, valid: str = "valid") -> DataFrame:
    """drafts (uid, translation) with the revised text where there is one that is valid, and whether it was taken."""
    r = revised.select("uid", F.col("translation").alias("__r"), F.col(valid).alias("__ok"))
    joined = drafts.join(r, "uid", "left")
    take = F.col("__r").isNotNull() & (F.col("__r") != "") & F.coalesce("__ok", F.lit(False))
    return joined.withColumns({"polished": take, "translation": F.when(take, F.col("__r")).otherwise(F.col("translation"))}).drop("__r", "__ok")
