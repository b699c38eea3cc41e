"""Folders for what a job keeps between its steps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a temporary one in local mode where that is unset.

    On a cluster an unset folder is an error: what executors write to their own disks the others can't read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="setforge-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def passing_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/setforge-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def passing_folder(spark: SparkSession) -> str:
    """The same as a folder that exists, for what reads and writes files itself; the shared folder must be mounted."""
    path = re.sub("^file:(//)?(?=/)", "", passing_path(spark))
    if not path.startswith("/"):
        raise RuntimeError(f"{path} is on no mounted file system")
    os.makedirs(path)
    return path
