"""Packing ordered segments into bounded batches, and context before a batch.

Packing is greedy and starts anew when a batch is full, so it is a fold over the
ordered segments of a group: one pass over the group's sorted rows.  Groups (documents,
conversations, a chosen number of slices of a run) keep that fold short and let it run
in parallel; a group must fit into a worker.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import constants as C


def greedy_batches(rows: DataFrame, group: str, order: str, text: str, max_chars: int, max_items: int | None = None, size=F.length) -> DataFrame:
    """rows plus batch_no (from 1 within the group) and local_id (from 1 within the batch).

    A segment opens a batch when the batch before would pass max_chars or has
    max_items; a segment longer than max_chars stands alone.
    """
    out = StructType([*rows.schema.fields, StructField("batch_no", IntegerType()), StructField("local_id", IntegerType())])
    sized = rows.withColumn("__size", F.coalesce(size(F.col(text)), F.lit(0)).cast("bigint"))
    names, at = rows.columns, rows.columns.index(order)

    def fold(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column(at), null_placement="at_start"))
        batch, chars, items = 0, 0, 0
        numbers, places = [], []
        for n in table.column(len(names)).to_pylist():
            if not items or chars + n > max_chars or (max_items is not None and items >= max_items):
                batch, chars, items = batch + 1, 0, 0
            chars, items = chars + n, items + 1
            numbers.append(batch)
            places.append(items)
        kept = [table.column(k) for k in range(len(names))]
        return pa.table([*kept, pa.array(numbers, pa.int32()), pa.array(places, pa.int32())], names=[*names, "batch_no", "local_id"])

    return sized.groupBy(group).applyInArrow(fold, out)


def context_before(rows: DataFrame, group: str, order: str, text: str, k: int) -> DataFrame:
    """rows plus context: the texts of the last k segments before; none for k = 0."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-k, -1)
    context = F.collect_list(text).over(w) if k else F.array().cast("array<string>")
    return rows.withColumn("context", context)


def budgeted_context(rows: DataFrame, group: str, order: str, source: str, target: str, budget: int = C.CONTEXT_BUDGET) -> DataFrame:
    """One row for each segment that serves as context for what follows the group's end.

    Counted from the last segment backwards: each takes both texts' lengths from the
    budget, texts are cut to what is left, and nothing more is taken once it is gone.
    """
    back = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    used = F.sum(F.length(source) + F.length(target)).over(back)
    left = (F.lit(budget) - F.coalesce(used, F.lit(0))).cast("int")
    rows = rows.withColumn("left", left).where("left > 0")
    return rows.select(group, order, F.expr(f"substring({source}, 1, left)").alias("source_cut"), F.expr(f"substring({target}, 1, left)").alias("target_cut"), F.col("left"))


def runs(rows: DataFrame, group: str, order: str, good: str) -> DataFrame:
    """First and last place of each maximal run of rows where ``good`` holds."""
    w = Window.partitionBy(group).orderBy(order)
    islands = rows.where(good).withColumn("__island", F.col(order) - F.row_number().over(w))
    return islands.groupBy(group, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__island")


def byte_chunks(text, limit: int):
    """Pieces of at most ``limit`` bytes: sentences, then words, then as many characters as fit, put together greedily with spaces."""
    none = F.expr("named_struct('done', cast(array() as array<string>), 'open', '')")

    def one_more(acc, c):
        fits = F.octet_length(F.concat(acc["open"], c)) <= limit
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, F.concat(acc["open"], c)).otherwise(c).alias("open"))

    def cut(word):
        return F.when(F.octet_length(word) <= limit, F.array(word)).otherwise(F.aggregate(F.split(word, ""), none, one_more, lambda acc: F.concat(acc["done"], F.array(acc["open"]))))

    atoms = F.flatten(
        F.transform(
            F.split(text, r"(?U)(?<=[.!?;])\s+"),
            lambda s: F.when(F.octet_length(s) <= limit, F.array(s)).otherwise(F.flatten(F.transform(F.split(s, r"(?U)\s+"), cut))),
        )
    )
    start = F.expr("named_struct('done', cast(array() as array<string>), 'open', '')")

    def add(acc, a):
        joined = F.when(acc["open"] == "", a).otherwise(F.concat(acc["open"], F.lit(" "), a))
        fits = F.octet_length(joined) <= limit
        return F.struct(F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits | (acc["open"] == ""), joined).otherwise(a).alias("open"))

    return F.aggregate(F.filter(atoms, lambda a: a != ""), start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
