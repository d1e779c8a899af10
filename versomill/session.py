"""Sessions for work outside of a cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int = 8, memory: str = "16g", **conf: str) -> SparkSession:
    """A local session; on a cluster, the cluster's settings stand and this is not needed."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
