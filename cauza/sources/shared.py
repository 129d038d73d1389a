"""A place that all executors see, for tables that end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without that setting a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            folder = tempfile.mkdtemp(prefix="cauza-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = "file://" + folder
        sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that is not in use."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
