"""Session settings for cluster runs and local tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that keep the plans sound on a large cluster. Shuffle partitions are
# left to the cluster; adaptive execution merges small ones and splits skewed
# join partitions. A join side is broadcast only when Spark's own size figures
# put it under the threshold, else both sides are sort-merged.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "kerbside", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``SCALE_CONF``; ``conf`` keys use ``__`` in place of dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
