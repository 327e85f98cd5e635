"""Tables in the folder that the driver and all executors share, ``spark.checkpoint.dir``: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where none is named, a session on this machine alone gets a temporary one, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str, path: str | None = None) -> DataFrame:
    """Write ``df``, partitioned by columns if any are named, and return a reader of it."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
