"""Session settings that every query of this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results or plans; cluster-specific sizes are left to spark-defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "tidemark", **more: str) -> SparkSession:
    """A session with the settings above; ``more`` wins over them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
