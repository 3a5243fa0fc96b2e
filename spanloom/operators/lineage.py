"""Rows that stay as they were computed once, and the folder for what a job writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset and Spark runs in one process, a folder of its own, removed at its end."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _own.get("folder")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own["folder"] = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_own: dict[str, str] = {}


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder there; it goes with the JVM."""
    path = f"{shared_folder(spark).rstrip('/')}/spanloom-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def fixed(rows: DataFrame) -> DataFrame:
    """rows, computed once and written, so that all that reads them reads the same rows in the same partitions."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def written(rows: DataFrame) -> DataFrame:
    """rows, computed once and read again from Parquet, so that Spark knows their size."""
    to = new_folder(rows.sparkSession)
    rows.write.parquet(to)
    return rows.sparkSession.read.schema(rows.schema).parquet(to)
