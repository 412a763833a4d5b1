"""Cutting lineage by tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows read back: what made them isn't run again, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
