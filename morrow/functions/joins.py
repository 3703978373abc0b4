"""Joins of a large side with a side of unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morrow.schemas import PAIR_KEYS


def lookup_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a large side with a side whose keys are unique (or only filter by it).

    Catalyst broadcasts ``right`` where its size is under the session's limit.  Beyond it
    both sides are shuffled once, and adaptive execution splits the partition of a hot
    left key over several tasks, each with a copy of the matching right rows
    (``spark.sql.adaptive.skewJoin``).  Either side occurs once in the plan, so chains of
    lookups grow linearly.  ``how`` is one of left, inner, left_semi and left_anti: joins
    whose left side can be split.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup join: {how}")
    return left.join(right, [on] if isinstance(on, str) else list(on), how)


def pair_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two sides on (user, item) by a shuffle of both.

    Either side grows with the log.  The size that Catalyst plans with is that of the
    compressed files and counts an exploded list as one row, so it would broadcast
    millions of pairs; the hint keeps them out of the driver.
    """
    return left.join(right.hint("merge"), list(PAIR_KEYS), how)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as a single scalar subquery."""
    values = row.select(F.struct(*row.columns).alias("row")).scalar()
    return df.select("*", *[values.getField(name).alias(name) for name in row.columns])
