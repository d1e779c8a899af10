"""Figures of runs, and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def engine_stats(calls: DataFrame) -> DataFrame:
    """calls (engine, ok, seconds) by engine."""
    return calls.groupBy("engine").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.sum("seconds"), 6).alias("seconds"))


def segments_by_engine(rows: DataFrame) -> DataFrame:
    """Segments by engine, results of the cache under a name of their own."""
    name = F.when(F.col("hit"), F.concat(F.col("engine"), F.lit(" (cache)"))).otherwise(F.col("engine"))
    return rows.groupBy(name.alias("engine")).agg(F.count("*").alias("n"))


def failures(calls: DataFrame) -> DataFrame:
    """Failed attempts by engine and kind of error."""
    return calls.where(~F.col("ok")).groupBy("engine", "error_class").agg(F.count("*").alias("n"))


def first_errors(calls: DataFrame, order: str, kept: int = 50, shown: int = 10) -> DataFrame:
    """The first errors in order: as many as are kept, of which the first are shown."""
    first = calls.where(~F.col("ok")).orderBy(order).limit(kept)
    return first.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(order, "error_class"))), lambda x: x["error_class"]), 1, shown).alias("errors"))


def retry_waits(calls: DataFrame, unit: list[str], order: str, retries: int = 3) -> DataFrame:
    """attempt (from 0) and the wait after each failed attempt but the last."""
    w = Window.partitionBy(*unit).orderBy(order)
    numbered = calls.withColumn("attempt", (F.row_number().over(w) - 1).cast("int"))
    wait = F.when(~F.col("ok") & (F.col("attempt") < retries - 1) & (F.col("error_class") != "EngineUnavailable"), X.wait_seconds(F.col("attempt"), F.col("error_class") == "RateLimited"))
    return numbered.withColumn("wait", wait)


def run_comparison(rows: DataFrame, key: list[str], run: str, text: str, runs: list[str]) -> DataFrame:
    """One row a key with each run's text beside the others'."""
    return rows.groupBy(*key).pivot(run, runs).agg(F.first(text))


def comparison_markdown(rows: DataFrame, key: str, source: str, runs: list[str]) -> DataFrame:
    lines = [F.when(F.col(f"`{r}`").isNotNull(), F.concat(F.lit(f"- **{r}**: "), F.col(f"`{r}`"))) for r in runs]
    return rows.select(key, F.concat_ws("\n", F.concat(F.lit("> "), F.col(source)), *lines).alias("markdown"))


def new_errors(found: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Rows whose key the base has not; repeated rows stay."""
    return found.join(base.select(key).distinct(), key, "left_anti")


def numbered_slugs(rows: DataFrame, heading: Column, group: list[str], order: list[str]) -> DataFrame:
    """Anchors of headings: equal ones get -1, -2 and so on from the second."""
    rows = rows.withColumn("slug", X.slug(heading))
    n = F.row_number().over(Window.partitionBy(*group, "slug").orderBy(*order)) - 1
    return rows.withColumn("anchor", F.when(n == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", n)))


def missing_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (file, target) without such an anchor."""
    return links.join(anchors.select(F.col("file"), F.col("anchor").alias("target")), ["file", "target"], "left_anti")


def summary(rows: DataFrame, judged: Column | None = None) -> DataFrame:
    """One row of figures over segments (source, translation); those not ``judged`` are neither translated nor untranslated."""
    judged = F.lit(True) if judged is None else judged
    missing = X.untranslated(F.col("translation"))
    return rows.agg(
        F.count("*").alias("segments"),
        F.sum(F.length("source")).cast("bigint").alias("chars"),
        F.count_if(judged & ~missing).alias("translated"),
        F.count_if(judged & missing).alias("untranslated"),
        F.when(F.count_if(judged & missing) == 0, 0).otherwise(2).alias("exit_code"),
    )


def run_report(segments: DataFrame, calls: DataFrame, archives: DataFrame, glossary: DataFrame | None, models: dict[str, str], seconds: float, polished: int = 0, quality: DataFrame | None = None, qa: DataFrame | None = None) -> dict:
    """A run's figures as one dict, ready for JSON; only sums and the first ten errors come to the driver.

    ``segments`` has source, translation, engine and hit; ``archives`` name and how many
    translations were put in as they were, put in as plain text, or are missing.
    """
    total = summary(segments).collect()[0]
    placed = archives.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("applied", "lenient", "untranslated")], F.array_sort(F.collect_list("name")).alias("names")).collect()[0]
    by_engine = calls.groupBy("engine").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures")).collect()
    errors = calls.where(~F.col("ok")).select(F.concat_ws(": ", "engine", "error_class").alias("e")).limit(10).collect()

    def one(df: DataFrame | None) -> dict | None:
        return None if df is None else next((r.asDict(recursive=True) for r in df.limit(1).collect()), None)

    return {
        "output": placed["names"],
        "quality": one(quality),
        "qa": one(qa),
        "seconds": round(seconds, 1),
        "segments": total["segments"],
        "chars": total["chars"] or 0,
        "translated": placed["applied"],
        "untranslated": placed["untranslated"],
        "selected_missing": total["untranslated"],
        "markup_fallbacks": placed["lenient"],
        "engine_segments": {r["engine"]: r["n"] for r in segments_by_engine(segments.where(~X.untranslated(F.col("translation")))).collect()},
        "engine_models": {k: v for k, v in models.items() if v},
        "engine_calls": {r["engine"]: r["calls"] for r in by_engine},
        "failures": {r["engine"]: r["failures"] for r in by_engine if r["failures"]},
        "polished_segments": polished,
        "cache_hits": segments.where("hit").count(),
        "glossary_size": glossary.count() if glossary is not None else 0,
        "errors": [r["e"] for r in errors],
    }
