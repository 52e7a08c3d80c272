"""Session factory with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "watchloom", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling; ``conf`` adds or overrides (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
