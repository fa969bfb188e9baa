"""Session defaults for tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "aforetime", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the caller brings its own session; nothing in the library
    depends on these values except the UTC session time zone.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
