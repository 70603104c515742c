"""Where intermediate and versioned tables are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own_folder.get(app) or _own_folder.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
