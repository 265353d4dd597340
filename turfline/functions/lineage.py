"""Cutting a long lineage at a table in shared storage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    It is the one set on the context or named in ``spark.checkpoint.dir``. Only
    a local session without either gets a temporary folder, removed at exit.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="turfline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/turfline-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path below the folder of this application, removed by ``drop_written``."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that still read them must be stored before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The rows are computed once, later reads prune columns, and the table's true
    size is known to the planner. A lost executor costs a read, not a rerun.
    The tables of an application share a folder, see ``drop_written``.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
