"""Sessions for tests, benchmarks and local checks.  On a cluster the caller brings its own session."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{n}]").appName("statproof")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("STATPROOF_DRIVER_MEMORY", "8g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.host", "127.0.0.1")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
