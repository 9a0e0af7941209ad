"""The session settings that the queries are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitting tool sets these."""
    cores = cores or os.cpu_count() or 4
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()
