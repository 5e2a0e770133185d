"""Session construction and cluster-wide settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces or splits
# shuffle partitions at run time; skew-join splitting protects the joins that
# carry a hot key (one key may hold a third of all rows).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "clusterlens", extra: dict | None = None) -> SparkSession:
    """Session for tests and local runs. On a cluster, use the provided session."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
