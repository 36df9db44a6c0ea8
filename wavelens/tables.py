"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset in local mode (tests), an error elsewhere."""
    context, place = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not place and context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="wavelens-")
    if place and context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return place or context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage that outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
