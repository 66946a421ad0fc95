"""Spark session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "corpus_audit", master: str | None = None, **options) -> SparkSession:
    """A session with adaptive execution and small Arrow batches (one row may be a large file)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
        # Plans here hold hundreds of expressions; recording a call site for each costs more than planning.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **options,
    }
    if master and master.startswith("local"):
        settings.setdefault("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
        settings.setdefault("spark.driver.memory", "8g")
        settings.setdefault("spark.ui.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
