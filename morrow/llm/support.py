"""Helpers of the corpus operators: shared stages and the columns of documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: White space of the contracts: the bytes 0x20 and 0x09 to 0x0D.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where it is unset, a
    local master gets a temporary folder; any other master is refused, since its
    executors would write to different disks.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write the frame once to the shared folder and read the copy."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def body(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def single_spaced(text: Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def documents_like(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` and no other."""
    return df.select(*DOCUMENT_COLUMNS)
