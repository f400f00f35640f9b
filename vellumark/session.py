"""A Spark session with the settings that the engine's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "vellumark", cpus: int | None = None, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """UTC session time, adaptive execution; ``cpus`` makes it local, else the cluster's master is used."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if cpus:
        b = b.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
