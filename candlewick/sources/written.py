"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below spark.checkpoint.dir; where that is unset, a local session's own, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or tempfile.mkdtemp(prefix="candlewick-")).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: lineage ends there, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name) + ".parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
