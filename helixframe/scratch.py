"""Intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _private_folder() -> str:
    return tempfile.mkdtemp(prefix="scratch-")


def scratch_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's own checkpoint folder.

    Where neither is set: on a local master, as in tests, a private one; on a cluster, one
    in the warehouse if that is in a shared file system. A warehouse on each machine's own
    disk, which is Spark's default, would scatter the files, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = _private_folder() if context.master.startswith("local") else _in_warehouse(spark.conf.get("spark.sql.warehouse.dir"))
    return named.rstrip("/")


def _in_warehouse(warehouse: str) -> str:
    if ":/" not in warehouse or warehouse.startswith("file:"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse {warehouse!r} is on each machine's own disk")
    return f"{warehouse.rstrip('/')}/_scratch"


def settled(df: DataFrame) -> DataFrame:
    """Computed once, its lineage cut by a reliable checkpoint in the scratch folder.

    Spark deletes the files with the last reference to the result where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems reach it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
