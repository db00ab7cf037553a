"""Sessions as this engine wants them (UTC, adaptive execution, ANSI mode as Spark has it), and scratch folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | more
    return SparkSession.builder.master(master).appName("provengine").config(map=conf).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared scratch space that spark.checkpoint.dir names; a local one only for a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    return f"{root}/{uuid.uuid4().hex}"
