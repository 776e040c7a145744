"""Sessions for local runs; on a cluster the submitter's settings hold."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with UTC time, adaptive execution and a shuffle partition for each core."""
    n = partitions or (os.cpu_count() if cpus == "*" else int(cpus)) or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
