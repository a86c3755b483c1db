"""Folders for tables that a query writes and reads again: shared by the cluster, removed at the end."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import SparkSession

#: Used only by a local master whose session names no checkpoint folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints"

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a cluster without that setting raises."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = LOCAL_DIR
    path = f"{where.rstrip('/')}/pairloom-{uuid.uuid4().hex}/{name}"
    _made[path] = spark
    return path


def clear() -> None:
    """Remove every folder that :func:`folder` gave."""
    while _made:
        path, spark = _made.popitem()
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(clear)
