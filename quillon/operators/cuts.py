"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the session names; without one there is no place that all executors are known to see, so this refuses."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named:
        raise ValueError(f"{SETTING} names no folder; set it to one that the driver and all executors share")
    return f"{named.rstrip('/')}/quillon/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint. It is the session's to delete, with its folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_path(df.sparkSession, "checkpoint"))
    return df.checkpoint()
