"""Stage boundaries.

A stage that several later jobs read is written once, as parquet, to the shared
folder named by ``spark.checkpoint.dir``.  The copy survives the loss of any
executor and keeps column pruning, filter pushdown and size statistics.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names.

    Only a local master, whose tasks all see the driver's disk, gets a temporary folder
    where none is named; elsewhere every machine would write to a disk of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-morrow-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def write_stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the frame once and return a frame that reads the copy."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
