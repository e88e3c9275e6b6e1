"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOCAL = "/tmp/tidemark"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine if driver and executors are one process, else an
    error. Checkpoints of the session go there too, unless it has a folder for them already."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = f"file://{LOCAL}"
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run. Its results may be read as long as the application lives; it is removed when the
    application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder
