"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC buckets, runtime re-planning of skewed joins, Arrow batches of a bounded number of rows, and no call sites kept for Columns (they make long expressions slow to build).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(master: str = "local[*]", app: str = "chainlake", **more: str) -> SparkSession:
    """A session with the settings above; `more` overrides them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
