"""Ranks, top-k rows and quantiles without an unbounded window partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.stages import write_stage

_GROUP_LIMIT = 1000  # default of spark.sql.optimizer.windowGroupLimitThreshold


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def top_rows(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    *,
    salts: int = 64,
) -> DataFrame:
    """First ``k`` rows of each group with their rank.

    Up to the group-limit threshold Spark keeps only ``k`` rows per group before
    the shuffle, so a hot group sends ``k`` rows per map task.  Above it the same
    is done in two steps over salted groups.
    """
    keys = _columns(by)
    if k > _GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__part", F.row_number().over(part))
            .filter(F.col("__part") <= k)
            .drop("__salt", "__part")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def bounded_rank(
    df: DataFrame, by: str | Sequence[str], order: Sequence[Column], rank: str
) -> DataFrame:
    """Rank inside groups whose size has a fixed bound, such as a candidate cap."""
    window = Window.partitionBy(*_columns(by)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window))


def bucketed_rank(
    df: DataFrame,
    by: str | Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    rank: str,
    *,
    descending: bool = False,
) -> DataFrame:
    """Rank every row of groups of any size.

    ``bucket`` must grow (or, with ``descending``, fall) along ``order`` and be the
    same for equal order keys.  Rows are ranked inside (group, bucket); the number
    of rows in earlier buckets comes from the pre-aggregated bucket counts.
    """
    keys = _columns(by)
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    direction = F.desc("__bucket") if descending else F.asc("__bucket")
    before = (
        Window.partitionBy(*keys)
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys,
        "__bucket",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = df.withColumn("__inside", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "__bucket"])
        .withColumn(rank, (F.col("__offset") + F.col("__inside")).cast("bigint"))
        .drop("__bucket", "__inside", "__offset")
    )


def global_rank(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """Position of every row in one total order, starting at 1.

    The rows are range-sorted and written once with their partition and position;
    the partition sizes (one row per task) give the offsets.  No row is ever
    moved to a single task.
    """
    ordered = write_stage(
        df.orderBy(*order).withColumn("__position", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("__position", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    inside = F.col("__position").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(rank, (F.col("__offset") + inside + 1).cast("bigint"))
        .drop("__part", "__offset", "__position")
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Histogram of a column with few distinct values."""
    return df.groupBy(*by, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def nearest_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Nearest-rank quantiles: the sorted value at index ``round((n - 1) * q)``.

    Works on the histogram of the column.  Its size is the number of distinct
    values, which the union cap bounds for per-user counts and for ratios of two
    such counts; it does not grow with the number of users.
    """
    keys = list(by)
    histogram = value_counts(df, value, keys)
    running = Window.partitionBy(*keys).orderBy("value")
    whole = Window.partitionBy(*keys)
    placed = histogram.select(
        *keys,
        "value",
        F.sum("rows").over(running).alias("through"),
        F.sum("rows").over(whole).alias("n"),
    )
    picks = [
        F.min(
            F.when(F.col("through") > F.floor((F.col("n") - 1) * q + 0.5), F.col("value"))
        ).alias(name)
        for name, q in quantiles.items()
    ]
    return placed.groupBy(*keys).agg(*picks)


def order_breaks(
    df: DataFrame, keys: Sequence[str], position: str, *, bucket_rows: int = 1 << 20
) -> DataFrame:
    """Count rows whose key is below, or equal to, the key of the row before.

    ``position`` is the stored row position.  Neighbours are compared inside
    position buckets; across a bucket edge only the first and last keys meet.
    """
    key = F.struct(*keys)
    rows = df.select(
        F.floor(F.col(position) / bucket_rows).alias("bucket"),
        F.col(position).alias("position"),
        key.alias("key"),
    )
    inside = Window.partitionBy("bucket").orderBy("position")
    steps = rows.select("key", F.lag("key").over(inside).alias("previous"))
    edges = rows.groupBy("bucket").agg(
        F.min_by("key", "position").alias("key"), F.max_by("key", "position").alias("last")
    )
    across = edges.select(
        "key", F.lag("last").over(Window.orderBy("bucket")).alias("previous")
    )
    pairs = steps.unionByName(across).filter(F.col("previous").isNotNull())
    return pairs.agg(
        F.count_if(F.col("key") < F.col("previous")).alias("out_of_order_rows"),
        F.count_if(F.col("key") == F.col("previous")).alias("repeated_neighbours"),
    )
