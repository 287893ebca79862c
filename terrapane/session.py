"""Session settings and the client object."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the expressions here rely on, and what holds at any size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "terrapane", master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (b.master(master) if master else b).getOrCreate()
