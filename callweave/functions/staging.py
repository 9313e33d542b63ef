"""Materialisation points in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="callweave-")
        shared_dir.own = named
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts lineage.

    A lost executor costs only the tasks it was running: what is staged is in
    the shared store, not in shuffle files or executor memory.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
