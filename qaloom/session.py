"""Session settings shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "qaloom", cores: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the submitted configuration rules and this is not needed."""
    n = partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QALOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
