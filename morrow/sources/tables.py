"""Parquet sources and sinks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morrow.functions.joins import lookup_join
from morrow.schemas import RAW_INTERACTION, TARGET_USER, require, require_columns


def scan_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw interactions with an exact schema check; metadata only, nothing is read."""
    return require(spark.read.parquet(*paths), RAW_INTERACTION, "raw interactions")


def scan_targets(spark: SparkSession, *paths: str) -> DataFrame:
    return require(spark.read.parquet(*paths), TARGET_USER, "target users")


def table_source(
    spark: SparkSession, source: DataFrame | str, expected: dict[str, T.DataType], name: str
) -> DataFrame:
    """A frame or a path, with one schema check for both."""
    frame = spark.read.parquet(source) if isinstance(source, str) else source
    return require(frame, expected, name)


def scan_parts(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Several parquet parts, or globs, as one table, reading only some columns."""
    frame = spark.read.parquet(*paths)
    if columns is None:
        return frame
    return require_columns(frame, columns, "parts").select(*columns)


def read_users(table: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of some users: an id range for row-group pruning, then an exact filter.

    The range is two numbers; the pushed filter skips the row groups of tables that
    were written in user order.
    """
    low, high = users.agg(F.min("user_id"), F.max("user_id")).first()
    if low is None:
        return table.limit(0)
    ranged = table.filter(F.col("user_id").between(low, high))
    return lookup_join(ranged, users.select("user_id"), "user_id", "left_semi")


def write_sorted(
    df: DataFrame, path: str, keys: Sequence[str], *, partitions: int | None = None
) -> None:
    """Range-partitioned, key-ordered parquet: file statistics follow the keys.

    All keys take part in the range split, so rows of one hot user spread over
    files that stay in order.
    """
    ranged = (
        df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    )
    ranged.sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def user_shards(users: DataFrame, shards: int) -> DataFrame:
    """Users with the number of their contiguous id range."""
    ranged = users.select("user_id").repartitionByRange(shards, "user_id")
    return ranged.withColumn("shard", F.spark_partition_id())


def user_shards_of(users: DataFrame, ranked: DataFrame, users_per_shard: int) -> DataFrame:
    """Users in fixed-size contiguous shards from their dense group ids."""
    return lookup_join(users.select("user_id"), ranked, "user_id", "inner").select(
        "user_id", F.floor(F.col("group_id") / users_per_shard).alias("shard")
    )


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Store the tables of one artifact next to each other."""
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_factor_model(folder: str, model: ALSModel, users: DataFrame, items: DataFrame) -> None:
    """The Spark model and its id-keyed factor tables."""
    model.write().save(f"{folder}/model")
    write_tables(folder, user_factors=users, item_factors=items)


def read_factor_model(spark: SparkSession, folder: str) -> tuple[ALSModel, DataFrame, DataFrame]:
    tables = read_tables(spark, folder, "user_factors", "item_factors")
    return ALSModel.load(f"{folder}/model"), tables["user_factors"], tables["item_factors"]


def _log_rows(spark: SparkSession, log_path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(log_path)
    except AnalysisException as error:  # the first run finds no log
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_runs(log_path: str, runs: DataFrame) -> DataFrame:
    """Append runs whose id is not in the log yet; returns the appended rows.

    Every append is an attempt of its own.  Two writers that both find a run missing both
    append it; ``read_runs`` then shows the earlier attempt alone, so that appending again,
    or at the same time, changes nothing.
    """
    log = _log_rows(runs.sparkSession, log_path)
    fresh = runs if log is None else runs.join(log.select("run_id"), "run_id", "left_anti")
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    fresh.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(log_path)
    return fresh


def read_runs(spark: SparkSession, log_path: str) -> DataFrame:
    """The rows of the first attempt of every run."""
    log = spark.read.parquet(log_path)
    first = log.groupBy("run_id").agg(F.min("attempt").alias("attempt"))
    return log.join(first, ["run_id", "attempt"], "left_semi").drop("attempt")


def write_parameters(path: str, spark: SparkSession, name: str, parameters: str) -> None:
    """Store named parameters (a JSON document) as one row."""
    schema = "name string, parameters string"
    spark.createDataFrame([(name, parameters)], schema).coalesce(1).write.json(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, parameters string").json(path)
