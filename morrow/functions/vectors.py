"""Dense vector arithmetic on ``ARRAY<FLOAT>`` columns with the array functions.

Writing the sums out element by element would exceed the method size limit of
generated code at a few dozen dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from morrow.functions.expressions import col

ZERO_NORM = 1e-12


def dot(left: str | Column, right: str | Column) -> Column:
    """Sum of products, accumulated in double from the first element to the last."""
    products = F.zip_with(
        col(left), col(right), lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: str | Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: str | Column) -> Column:
    """Scale to length one; a zero vector has no direction and becomes null.

    The length is repeated into an array first: inside a lambda it would be computed
    again for every component.
    """
    vector = col(vector)
    length = norm(vector)
    lengths = F.array_repeat(length, F.size(vector))
    scaled = F.zip_with(vector, lengths, lambda value, size: value.cast("double") / size)
    return F.when(length > ZERO_NORM, scaled)


def clip_cosine(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def non_finite(vector: str | Column) -> Column:
    """True when any component is null, NaN or infinite."""
    return F.exists(
        col(vector),
        lambda value: value.isNull()
        | F.isnan(value)
        | (F.abs(value.cast("double")) == F.lit(float("inf"))),
    )
