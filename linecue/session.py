"""A local session with the settings the tests and the benchmark share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", memory: str = "6g", app: str = "linecue", shuffle_partitions: int = 8) -> SparkSession:
    """Session on local[cpus]; a cluster brings its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
