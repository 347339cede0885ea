"""Reliable storage for cut lineage: always the shared folder the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    Taken from the session (``spark.checkpoint.dir`` or an earlier ``setCheckpointDir``);
    without one there is no folder that every executor is known to reach.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame once so that later passes see the same rows and partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
