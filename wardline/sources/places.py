"""Folders for files that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a temporary one where it is unset, on local masters only.

    What is written there goes when the session ends.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        set_by_code = sc._jsc.sc().getCheckpointDir()
        if set_by_code.isDefined():
            folder = set_by_code.get()
        elif sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="wardline-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
