"""The folder for tables that a plan writes on its way."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, that of spark.checkpoint.dir if the session names one. Only a
    session of this one machine that names none (tests) is given one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="posframe-"))
    return context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
