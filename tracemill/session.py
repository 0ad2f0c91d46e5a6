"""A Spark session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", name: str = "tracemill", **conf: object) -> SparkSession:
    """UTC sessions with adaptive execution; `conf` has more settings, with __ for dots in their names."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
