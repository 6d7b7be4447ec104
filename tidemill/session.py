"""Session builder with the settings that the operators assume."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """S03. A session in UTC with AQE on. master None keeps what spark-submit gave, or else local cores."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which driver and executors share; a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return found.rstrip("/")
