"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``.

    Only a session in local mode (tests), where the setting is missing, gets a temporary
    folder; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    root = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()
