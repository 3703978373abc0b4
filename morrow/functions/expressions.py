"""Scalar expressions over the daily interaction columns."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_WATCH_SECONDS = 60
MICROSECONDS_PER_HOUR = 3_600_000_000.0


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def instant(value: datetime | Column) -> Column:
    """A reference time given as a Python value or as a column.

    The value travels as text: a timestamp literal would pass through the time zones
    of the driver and of the session.
    """
    if isinstance(value, Column):
        return value
    if value.tzinfo is not None:
        raise ValueError("reference times carry no time zone")
    return F.lit(value.isoformat(sep=" ")).cast(T.TimestampNTZType())


def event_indicator(name: str, event_type: str | Column = "event_type") -> Column:
    return (col(event_type) == F.lit(name)).cast("int")


def long_watch(watch_time: str | Column = "watch_time") -> Column:
    return col(watch_time) > LONG_WATCH_SECONDS


def positive(
    watch_time: str | Column = "watch_time",
    is_like: str | Column = "is_like",
    is_favorite: str | Column = "is_favorite",
) -> Column:
    """A watch over a minute, a like or a favourite."""
    return long_watch(watch_time) | (col(is_like) == 1) | (col(is_favorite) == 1)


def age_hours(moment: str | Column, reference: datetime | Column) -> Column:
    """Hours from ``moment`` to ``reference`` with microsecond resolution."""
    elapsed = F.timestamp_diff("MICROSECOND", col(moment), instant(reference))
    return elapsed.cast("double") / MICROSECONDS_PER_HOUR


def half_life_decay(age: Column, half_life_hours: float | None) -> Column:
    """Exponential decay; no half-life means no decay."""
    if half_life_hours is None:
        return F.lit(1.0)
    return F.exp(F.lit(-math.log(2.0)) * age / F.lit(float(half_life_hours)))


def event_strength() -> Column:
    """Seed weight that grows with views, a long watch, a like and a favourite."""
    return (
        F.lit(1.0)
        + F.log1p(F.col("views").cast("double"))
        + long_watch().cast("double")
        + F.col("is_like").cast("double")
        + F.col("is_favorite").cast("double")
    )


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``numerator / denominator`` as a float, zero without a positive denominator."""
    top, bottom = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def normalized_rank(rank: str | Column, size: int | Column) -> Column:
    """Map rank 1..size to the interval (0, 1], best first."""
    total = F.lit(size) if isinstance(size, int) else size
    return (total - col(rank) + 1).cast("double") / total.cast("double")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def total_of(values: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left + right, values)


def zero_sentinels(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace missing evidence by false or zero, according to the column type."""
    wanted = set(columns)
    projected = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if field.name in wanted:
            if isinstance(field.dataType, T.BooleanType):
                value = F.coalesce(value, F.lit(False))
            elif isinstance(field.dataType, T.NumericType):
                value = F.coalesce(value, F.lit(0).cast(field.dataType))
            else:
                raise TypeError(f"no sentinel for {field.name}: {field.dataType}")
        projected.append(value.alias(field.name))
    return df.select(*projected)


def finite(value: str | Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    number = col(value).cast("double")
    return (
        number.isNotNull()
        & ~F.isnan(number)
        & (F.abs(number) != F.lit(float("inf")))
    )
