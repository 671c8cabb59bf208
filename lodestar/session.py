"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI, adaptive execution with skewed-join splitting, UTC; a master only for local runs (clusters name their own)."""
    b = SparkSession.builder.appName(name)
    if master:
        cores = master.partition("[")[2].rstrip("]") or "1"
        n = os.cpu_count() if cores == "*" else int(cores)
        b = b.master(master).config("spark.sql.shuffle.partitions", str(n)).config("spark.ui.enabled", "false").config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.ansi.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
