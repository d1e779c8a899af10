"""Resumable runs over files that keep arriving.

Each micro-batch's new segments are looked up in the cache, the rest goes through the
engines once, and what they give, whichever engine it was, is written; the cache's new
rows are made of that.  The stream's own checkpoint tells which files were done, so a run
that ends goes on where it was; a batch that is run again replaces its folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache as K
from ..operators import translate as R

SEGMENTS = "doc_index long, seg_no long, uid string, kind string, source string, plain string"


def _known(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The newest row of each key among those that batches before n wrote: one table, of which a run again leaves out its own."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(folder)
    if not n or not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return K.read(spark, None)
    rows = spark.read.schema(f"{K.SCHEMA}, batch bigint").parquet(folder).where(F.col("batch") < n)
    return K.upsert(rows.drop("batch").limit(0), rows.drop("batch"), "key")


def start(spark: SparkSession, source: str, cache: str, out: str, checkpoint: str, engines: list[str], src: str, tgt: str, **options):
    """A query over Parquet files of segments; ``availableNow`` ends it when all are done."""

    def each(batch: DataFrame, n: int) -> None:
        done, _, _ = R.translate(batch, engines, _known(spark, cache, n), src, tgt, **options)
        done.write.mode("overwrite").parquet(f"{out}/batch={n}")
        # from what was written, so that engines are asked once
        again = spark.read.schema(done.schema).parquet(f"{out}/batch={n}")
        rows = R.cache_rows(again, engines, src, tgt, options.get("model"), options.get("polish", False))
        rows.write.mode("overwrite").parquet(f"{cache}/batch={n}")

    stream = spark.readStream.schema(SEGMENTS).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
