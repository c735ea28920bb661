"""Folders for files that a run writes and reads again."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder where driver and executors both can write: below spark.checkpoint.dir, or, on one machine alone, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
