"""Folders that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; a cluster is an error, as its machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "murmura-checkpoints")
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system, through Spark's own configuration."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes a path with all that is in it; whether it was there."""
    files, at = _at(spark, path)
    return files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def names_under(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it is not there."""
    files, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Gives a file another name, in one step where the file system can; false if the new name is taken."""
    files, at = _at(spark, old)
    return files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file."""
    files, at = _at(spark, path)
    out = files.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
