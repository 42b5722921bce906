"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that timestamps without a zone mean the same everywhere; AQE for run-time plans; nothing that fixes a size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tessera", master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
