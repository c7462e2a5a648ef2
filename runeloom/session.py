"""Session defaults. A session that exists already is used as it is."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

#: Settings of a new session. Adaptive execution splits skewed joins and merges small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter makes the session."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    b = SparkSession.builder.master(f"local[{cores}]").appName("runeloom")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
