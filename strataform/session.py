"""Sessions for local work; on a cluster pass your own session to every function."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that every operator is tested with.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str | None = None, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine with as many shuffle partitions as cores."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("strataform").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
