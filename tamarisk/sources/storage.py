"""Folders in the storage that driver and executors share, by Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """With scheme and authority: a path without is one of the default file system."""
    fs, where = _at(spark, path)
    return fs.makeQualified(where).toString()


def delete(spark: SparkSession, path: str) -> None:
    """The folder and all in it; none is no error."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where the session names none, a local
    session gets a folder of its own; a cluster session must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return qualified(spark, found.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-tamarisk-")
    spark.sparkContext.setCheckpointDir(made)
    return qualified(spark, made)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tamarisk/{label}-{uuid.uuid4().hex}"
