"""A corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as Parquet
into the shared folder and reads it again for the next one.

1. toxicity: documents that score 0.7 or more go.
2. near_dedup: one document stays of each class of near duplicates (five words, 0.8).
3. substring_dedup: sentences of repeated spans are cut out but where they stand
   first; documents of which nothing is left go.
4. decontamination: documents with 5 % or more of their words in benchmark windows go;
   from others such words are cut out.
5. bpe: token ids, and digests of ids and of the text decoded from them.

Null and empty texts pass all stages and have no tokens, nor are rows without an id ever
near duplicates.  Of repeated rows (equal id and text) one stays; rows that share an id but
not the text are judged each by its own text.  Ties cannot be: of near duplicates the one
with the smallest id stays, of repeated spans the first by id and place.  Texts of any
length are gone through whole.  Other columns may have any names and types and are kept up
to the last stage.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versomill.llm import bpe, decontam, neardup, substring, toxicity
from versomill.llm.common import dropped, new_folder, scratch, written

#: SQL can express neither the learned model nor the sketches; tests compare the stages with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cleaned(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=13, percent=5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            dropped(before, spark)
        before = path
    return docs
