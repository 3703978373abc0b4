"""Session settings that the operators are tuned for.

None of them changes results.  A cluster job may keep its own values; the
library never writes to the configuration of a session it is given.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skew join may cost one more exchange; that beats one overloaded task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def local_session(
    name: str = "morrow", cpus: int | str = 8, memory: str = "8g", **extra: str
) -> SparkSession:
    """Build the single-machine session used by tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(extra.pop("partitions", cpus)))
    )
    for key, value in {**RECOMMENDED_CONF, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
