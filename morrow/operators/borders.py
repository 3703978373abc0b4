"""Bin borders from mergeable summaries of weighted quantiles.

A summary is a table of values with weights, at most about twice ``size`` rows for each
feature and segment.  The values of a feature are dealt over segments by their hash, each
segment is summarised, and neighbouring segments are merged and summarised again, until
one is left.  No window ever holds a feature's values, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.stages import write_stage

_FEATURE_VALUE = ["feature", "value"]


def value_weights(rows: DataFrame, features: Sequence[str], weight: str | None = None) -> DataFrame:
    """``feature, value, weight``: the weight of each distinct value.

    Null and NaN values and rows without a positive weight count for nothing.
    """
    amount = (F.col(weight) if weight else F.lit(1)).cast("double")
    entries = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in features]
    )
    entry = rows.select(amount.alias("weight"), F.explode(entries).alias("e")).select("e.*", "weight")
    counted = entry.filter("value IS NOT NULL AND NOT isnan(value) AND weight > 0")
    return counted.groupBy(*_FEATURE_VALUE).agg(F.sum("weight").alias("weight"))


def summarize(weights: DataFrame, size: int) -> DataFrame:
    """Summary of each ``feature, segment``; a segment of up to ``size`` values is untouched.

    Beyond that, light values whose weight up to and with them falls in the same of
    ``size`` equal parts of the segment's weight become one entry, at the largest of
    them.  A value heavier than a part stays alone.  The weight up to any value changes by less than
    two parts, so by ``2 / size`` of the segment's weight.
    """
    group = ["feature", "segment"]
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("total") / size
    measured = weights.withColumns(
        {
            "total": F.sum("weight").over(whole),
            "values": F.count(F.lit(1)).over(whole),
            "place": F.count(F.lit(1)).over(upto),
            "reach": F.sum("weight").over(upto),
        }
    )
    alone = (F.col("values") <= size) | (F.col("weight") > part)
    return (
        measured.withColumn(
            "bucket", F.when(alone, -F.col("place")).otherwise(F.ceil(F.col("reach") / part))
        )
        .groupBy(*group, "bucket")
        .agg(F.max("value").alias("value"), F.sum("weight").alias("weight"))
        .drop("bucket")
    )


def merged_summaries(
    weights: DataFrame, size: int = 1024, segment_rows: int = 1 << 16, fan: int = 16
) -> tuple[DataFrame, int]:
    """One summary of each feature, ``feature, value, weight``, and the levels it took.

    The rank error is at most ``2 * levels / size`` of a feature's weight, and none where
    the feature has at most ``size`` distinct values.
    """
    if size < 2 or segment_rows < 1 or fan < 2:
        raise ValueError("size and fan must be at least 2, segment_rows at least 1")
    stored = write_stage(weights, "value_weights")
    segments = max(1, math.ceil(stored.count() / segment_rows))
    found = stored.withColumn("segment", F.pmod(F.xxhash64("value"), F.lit(segments)))
    levels = 1
    found = summarize(found, size)
    while segments > 1:
        segments = math.ceil(segments / fan)
        # A value lies in one segment only, so merging is stacking.
        found = summarize(found.withColumn("segment", F.floor(F.col("segment") / fan)), size)
        levels += 1
    return found.select(*_FEATURE_VALUE, "weight"), levels


def weighted_borders(
    rows: DataFrame,
    features: Sequence[str],
    bins: int,
    weight: str | None = None,
    size: int = 1024,
    segment_rows: int = 1 << 16,
) -> DataFrame:
    """``feature, borders``: ascending, at most ``bins - 1``, each starting a new bin.

    A border is the smallest value up to which at least ``i / bins`` of the weight lie,
    for i from 1 to ``bins - 1``; equal ones count once and the smallest value is none.
    A feature with a single value or without any is listed with an empty array.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    summary, _ = merged_summaries(value_weights(rows, features, weight), size, segment_rows)
    whole = Window.partitionBy("feature")
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.col("reach") * bins / F.sum("weight").over(whole)
    crossed = (
        summary.withColumns({"reach": F.sum("weight").over(upto), "place": F.count(F.lit(1)).over(upto)})
        .withColumn("i", F.least(F.floor(parts), F.lit(bins - 1)))
        .withColumn("last", F.lag("i", 1, 0).over(whole.orderBy("value")))
        .filter("i > last AND place > 1")
    )
    found = crossed.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("borders"))
    named = rows.sparkSession.createDataFrame([(n,) for n in features], "feature string")
    none = F.array().cast("array<double>")
    return named.join(found, "feature", "left").withColumn("borders", F.coalesce("borders", none))
