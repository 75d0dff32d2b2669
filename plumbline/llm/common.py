"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode only; a cluster
    has to name one, since executors do not share local disks.
    """
    importable(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_root()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="plumbline-")


#: Paths that this driver has given out.
_made: list[str] = []


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    _made.append(f"{work_root(spark)}/plumbline/{uuid.uuid4().hex}-{label}")
    return _made[-1]


def clean(label: str | None = None) -> int:
    """Removes this driver's work files, or those of one label; returns how many folders went.

    Results read them for as long as they are read: write those first.
    """
    gone = [p for p in _made if label is None or p.endswith(f"-{label}")]
    for path in gone:
        files, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        if files.get_file_info(at).type == fs.FileType.Directory:
            files.delete_dir(at)
        _made.remove(path)
    return len(gone)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns it as read back.

    Lineage ends there: a lost executor costs a re-read of files, not the work
    behind them.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Where executors do not see that folder, ship the package with --py-files.
    """
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def docs_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id (null included) is in ids; ids holds each id once.

    Always a merge join: the ids grow with the documents, and the plan that is
    measured on few is to be the one that runs on many.
    """
    kept = ids.select(F.col(id_col).alias("__kept_id")).hint("merge")
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")
