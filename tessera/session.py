"""Spark session with the settings the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", cores: str | int = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster, pass its own settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false")
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
