"""A session with the engine's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, runtime re-planning, columnar exchange with Python, a state store that spills.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # very long texts travel to Python: few in a batch
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.cteRecursionRowLimit": "-1",
    # no walk of Python's stack for each expression
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    """The session; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName("lakeloom").config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()
