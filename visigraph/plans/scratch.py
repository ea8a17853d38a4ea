"""The shared folder for intermediate tables and checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), below a new temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not base and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{(base or sc.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"
