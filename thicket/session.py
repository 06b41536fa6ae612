"""A Spark session with the settings that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "thicket", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution, Arrow transfer and UTC; partition sizes are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
