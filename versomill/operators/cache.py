"""The result cache: a table keyed by a hash of everything a result depends on.

Columns: key, engine, model, stage, src, tgt, source, result, created.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

SCHEMA = "key string, engine string, model string, stage string, src string, tgt string, source string, result string, created double"
GLOSSARY_SCHEMA = "book string, term string, target string"


def keyed(rows: DataFrame, engine: str, model: str | None, stage: str, src: str, tgt: str, text: str = "source") -> DataFrame:
    lits = [F.lit(x).cast("string") for x in (engine, model, stage, src, tgt)]
    return rows.withColumn("key", X.cache_key(*lits, F.col(text)))


def lookup(rows: DataFrame, cache: DataFrame | None) -> DataFrame:
    """rows plus result and hit; without a cache nothing is hit."""
    if cache is None:
        return rows.withColumns({"result": F.lit(None).cast("string"), "hit": F.lit(False)})
    found = rows.join(cache.select("key", "result").where("result is not null"), "key", "left")
    return found.withColumn("hit", F.col("result").isNotNull())


def uncached(rows: DataFrame, cache: DataFrame | None) -> DataFrame:
    return rows if cache is None else rows.join(cache.where("result is not null").select("key"), "key", "left_anti")


def whole_chunks(rows: DataFrame, *chunk: str) -> DataFrame:
    """Chunks and whether every row of them is a hit: only such chunks skip the engine."""
    return rows.groupBy(*chunk).agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"), F.every("hit").alias("from_cache"))


def upsert(old: DataFrame, new: DataFrame, *keys: str, newest: str = "created") -> DataFrame:
    """The union of both, of each key the row that is newest; new rows without a result are left out."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    if "result" in new.columns:
        both = both.where(F.col("result").isNotNull())
    rest = [c for c in old.columns if c not in keys]
    # one value a key: partial sums leave the machine, not rows
    order = ([F.col(newest)] if newest in old.columns else []) + [F.col("__new")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*old.columns)


def read(spark: SparkSession, path: str | None, schema: str = SCHEMA) -> DataFrame:
    """The cache at ``path``, empty if there is none yet."""
    if path is None:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_glossary(spark: SparkSession, path: str | None, book: str | None = None) -> DataFrame:
    """What earlier runs learned, of all books or of one."""
    rows = read(spark, path, GLOSSARY_SCHEMA)
    return rows if book is None else rows.where(F.col("book") == book)


def merged_glossary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, of each book's term the new target: what a run writes for the next one."""
    return upsert(old.select("book", "term", "target"), new.select("book", "term", "target"), "book", "term")


def write(cache: DataFrame, path: str) -> None:
    """Files by engine and stage would prune later reads; one writer a run replaces a version as a whole."""
    cache.write.mode("errorifexists").parquet(path)
