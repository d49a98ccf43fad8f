"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which checkpoint() uses too.

    Where the session has none, a folder given to setCheckpointDir() serves. A local
    master (a test) gets a temporary folder; on a cluster executors would each write
    to their own disk, so that there the folder must be set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kantele-"))
    return folder or str(context.getCheckpointDir())
