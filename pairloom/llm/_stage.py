"""Lineage cuts: tables written to the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local master whose session names no checkpoint folder, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local master has a default where none is named.

    On a cluster without the setting it raises: executors don't share a machine's own folders.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = DEFAULT_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table survives lost executors, is compressed, and cuts the lineage.
    Tables are removed by :func:`release`, :func:`drop_tables`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def fresh_name(taken: Iterable[str], name: str) -> str:
    """``name``, longer where a column of that name is there already (names ignore case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def tasks_for(rows: int, rows_a_task: int = 250_000, least: int = 8) -> int:
    """Tasks for so many narrow rows; shuffles of small tables then don't run one task a partition."""
    return max(least, -(-rows // rows_a_task))


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    with contextlib.suppress(Exception):  # the session may have ended
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Remove tables of :func:`stage_table` that no DataFrame still to be run reads."""
    for table in tables:
        _remove(table.staged_at)


def drop_tables() -> None:
    """Remove every table that :func:`stage_table` wrote; call it when their results are saved."""
    for path in list(_written):
        _remove(path)


atexit.register(drop_tables)
