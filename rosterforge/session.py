"""Session defaults shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: SQL settings that this library is written for.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rosterforge", cores: str | int = "*", memory: str | None = None) -> SparkSession:
    """The session of a submitted job, whose settings stay as they are, or else a local one with as many shuffle partitions as cores."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # spark-submit has made the settings
        return SparkSession.builder.appName(app).getOrCreate()
    cores = os.environ.get("BENCH_CPUS", cores)
    partitions = str(cores) if str(cores).isdigit() else str(os.cpu_count() or 8)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (SQL_SETTINGS | {"spark.sql.shuffle.partitions": partitions, "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}).items():
        builder = builder.config(key, value)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()
