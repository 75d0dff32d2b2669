"""Folders for work files."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that executors share, spark.checkpoint.dir; where that is unset, in a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local()
    return f"{root.rstrip('/')}/plumbline-work/{uuid.uuid4().hex}-{label}"


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="plumbline-")


def stash(df: DataFrame, label: str) -> DataFrame:
    """df as written to a new path and read back: lineage ends there, and a lost executor costs a read of files."""
    at = path(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
