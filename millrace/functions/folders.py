"""The folder all executors share, and intermediate results stored in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATH_OF_STORED = "_millrace_stored_path"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path of its own below the shared folder; nothing is created yet, and what is there goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/millrace-{purpose}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed now and written to the shared folder, so that a lost executor costs no recomputation.

    The table goes when the application ends, or with ``remove_stored`` when nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _PATH_OF_STORED, path)
    return table


def remove_stored(table: DataFrame) -> None:
    """Delete a table made by ``stored``; frames made from it can't be read any more."""
    _remove(table.sparkSession, getattr(table, _PATH_OF_STORED))


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own, if the application still runs."""
    if spark.sparkContext._jsc is None:
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
