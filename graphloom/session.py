"""Session construction and the settings every graphloom job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "graphloom", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
