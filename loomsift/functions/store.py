"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomsift.functions.files import remove

_local: list[str] = []
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="checkpoints-"))
    return _local[0]


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it is removed as the driver ends, for results are read until then."""
    if not _made:
        atexit.register(_remove)
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _remove() -> None:
    for folder in [*_made, *_local]:
        try:
            remove(folder)
        except (OSError, ValueError):  # another's to clean up: no access, or a file system that the driver can't reach
            continue


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
