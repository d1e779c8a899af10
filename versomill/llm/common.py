"""Shared plumbing: the cluster's shared folder, Arrow batches, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of the batches that operators work on.  Spark itself bounds the
#: bytes of an Arrow batch (spark.sql.execution.arrow.maxBytesPerBatch), a single
#: longer row makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a
    cluster there is no folder that may be guessed, so it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_versomill_dir", None) or "file://" + tempfile.mkdtemp(prefix="versomill-")
        spark._versomill_dir = base
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_open: list[list[str]] = []  # folders of each scratch that is open, the innermost last


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes all tables written within it at its end, but those that are to outlive it; they fall to the scratch around it, if there is one."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            dropped(path, spark)


def falls_to_scratch(path: str, outlive: bool = False) -> None:
    level = len(_open) - (2 if outlive else 1)
    if level >= 0:
        _open[level].append(path)


def written(df: DataFrame, tag: str, path: str | None = None, outlive: bool = False) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    It cuts the lineage and fixes what was computed: a lost executor costs a
    re-read and no second, perhaps different, computation.  Without a ``path`` the
    table is deleted with the scratch that it was made in; one that a result still
    reads must ``outlive`` it.
    """
    spark = df.sparkSession
    if path is None:
        path = new_folder(spark, tag)
        falls_to_scratch(path, outlive)
    with _small_batches(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches that Spark makes are small while a table is written; the session's settings are as before afterwards."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": f"{BATCH_BYTES}b"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dropped(df_path: str, spark: SparkSession) -> None:
    """Deletes a folder below the shared one once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that Python workers import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_versomill_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="versomill-")) / "versomill_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._versomill_shipped = True


#: What modules keep in a worker process from one task to the next, by module.
_kept: dict[str, dict] = {}


def kept_in_worker(module: str) -> dict:
    """A module's own dict that outlives a task; it is emptied once the worker runs another module's code."""
    return _kept.setdefault(module, {})


def _only(module: str) -> None:
    """Gives the memory of other modules' caches back: a worker may go on with the next stage of a job."""
    others = [d for m, d in _kept.items() if m != module and d]
    if not others:
        return
    for d in others:
        d.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _bounded(batches: Iterator[pa.RecordBatch], module: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of BATCH_ROWS rows and about BATCH_BYTES bytes at most."""
    _only(module)
    for b in batches:
        rows = min(BATCH_ROWS, max(1, BATCH_BYTES * b.num_rows // max(1, b.nbytes)))
        if b.num_rows <= rows:
            yield b
        else:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts."""
    _ship_package(df.sparkSession)
    module = fn.__module__
    return df.mapInArrow(lambda batches: fn(_bounded(batches, module)), schema)


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; all others, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def plain_names(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with its columns named c0, c1, ... in order, and the new names of doc_id and text.

    So no name that an operator gives can meet one of the table, and no name needs
    quotes; ``toDF(*docs.columns)`` names the columns as they were.
    """
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text, 128 bits together: with the id they tell rows of different texts apart."""
    return F.xxhash64(text), F.xxhash64(F.lit(0x5EED), text, F.length(text))


def crc_mod(col: str, m: int):
    """crc32 of an id as text, modulo m; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label of every row that has both."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())


def sampled_labels(labels: DataFrame, column: str, bound: int, keep=None) -> DataFrame:
    """About ``bound`` labelled ids at most, chosen by a hash of the id; all of them if there are fewer.

    Ids that occur several times get their largest label; null ids and labels are left out.
    """
    rows = label_rows(labels, column)
    if keep is not None:
        rows = rows.where(keep)
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))
