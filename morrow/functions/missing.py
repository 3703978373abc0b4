"""Which catalogue position is the n-th one a user has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.ranking import bucketed_rank

BUCKET = 4096


def unseen_before(seen: DataFrame) -> DataFrame:
    """For each seen catalogue position, how many unseen positions precede it.

    ``seen`` holds distinct (user_id, position) with positions counted from 1.  The
    i-th seen position p of a user has p - i unseen ones before it.  Ranks are
    taken inside blocks of catalogue positions, so a user who has seen the whole
    catalogue is still spread over many tasks.
    """
    block = F.floor((F.col("position") - 1) / BUCKET)
    ranked = bucketed_rank(seen, "user_id", block, [F.asc("position")], "seen_rank")
    return ranked.select(
        "user_id", (F.col("position") - F.col("seen_rank")).alias("unseen_before")
    )


def nth_unseen(gaps: DataFrame, requests: DataFrame) -> DataFrame:
    """Turn 1-based unseen ordinals into catalogue positions.

    The n-th unseen position is n plus the number of seen positions with fewer
    than n unseen ones before them.  ``gaps`` comes from :func:`unseen_before`;
    ``requests`` has user_id and ordinal, plus columns that are passed through.
    Gap counts and requests meet in blocks of ordinals with block offsets, so
    neither a user with many requests nor one with many gaps needs one task.
    """
    passed = [name for name in requests.columns if name not in ("user_id", "ordinal")]
    counted = gaps.groupBy("user_id", F.col("unseen_before").alias("ordinal")).agg(
        F.count(F.lit(1)).alias("gaps")
    )
    # A gap after exactly n unseen positions matters to ordinals above n only.
    marks = counted.select(
        "user_id", (F.col("ordinal") + 1).alias("ordinal"), "gaps", F.lit(False).alias("wanted")
    )
    for field in requests.schema.fields:
        if field.name in passed:
            marks = marks.withColumn(field.name, F.lit(None).cast(field.dataType))
    asked = requests.withColumn("ordinal", F.col("ordinal").cast("bigint")).withColumn(
        "gaps", F.lit(0).cast("bigint")
    ).withColumn("wanted", F.lit(True))
    both = marks.withColumn("ordinal", F.col("ordinal").cast("bigint")).unionByName(
        asked.select(*marks.columns)
    )
    both = both.withColumn("block", F.floor(F.col("ordinal") / BUCKET))
    sizes = both.groupBy("user_id", "block").agg(F.sum("gaps").alias("gaps"))
    before = (
        Window.partitionBy("user_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "user_id", "block", F.coalesce(F.sum("gaps").over(before), F.lit(0)).alias("offset")
    )
    inside = (
        Window.partitionBy("user_id", "block")
        .orderBy("ordinal")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("inside", F.sum("gaps").over(inside))
        .filter("wanted")
        .join(offsets, ["user_id", "block"])
        .select(
            "user_id",
            "ordinal",
            (F.col("ordinal") + F.col("offset") + F.col("inside")).alias("position"),
            *passed,
        )
    )
