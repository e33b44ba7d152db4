"""Session factory and session-wide facts.

ANSI mode stays on (Spark's default): the functions of this library guard every
division and logarithm themselves and return IEEE values in place of errors.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, make your own and use the library with it."""
    conf = {
        "spark.master": f"local[{cores or os.cpu_count()}]",
        "spark.sql.shuffle.partitions": str(cores or os.cpu_count()),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.config(map=conf).getOrCreate()


def info(spark: SparkSession) -> dict[str, str]:
    """What there is to compute with: version, master, parallelism, shuffle partitions."""
    return {
        "version": spark.version,
        "master": spark.sparkContext.master,
        "parallelism": str(spark.sparkContext.defaultParallelism),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
