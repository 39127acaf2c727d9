"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The shared folder: the session's spark.checkpoint.dir.

    A temporary one is set only in local mode where there is none; on a cluster it would be another disk on every machine.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder, removed at the latest when the driver ends."""
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or _base(spark)).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the reliable checkpoint folder, so that neither plan nor lineage grows with the rounds."""
    _base(df.sparkSession)
    return df.checkpoint()
