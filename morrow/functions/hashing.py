"""Deterministic 64-bit mixing hash.

The hash multiplies and adds modulo 2**64.  Spark's ``bigint`` arithmetic raises on
overflow in ANSI mode, and a product assembled from limbs is repeated hundreds of
times when the optimizer pushes a filter on the hash through its own steps.  So two
id columns go to NumPy in Arrow batches and one column comes back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multipliers and increment of the mixing function.
USER_MULTIPLIER = 0xD6E8FEB86659FD93
ITEM_MULTIPLIER = 0xA5A3564E27F8862F
GOLDEN_INCREMENT = 0x9E3779B97F4A7C15
FIRST_MIX_MULTIPLIER = 0xBF58476D1CE4E5B9
SECOND_MIX_MULTIPLIER = 0x94D049BB133111EB

_ROUNDS = ((30, FIRST_MIX_MULTIPLIER), (27, SECOND_MIX_MULTIPLIER))
_LAST_SHIFT = 31
_SIGN_BIT = 1 << 63


def fold_seed(seed: int, fold: str) -> int:
    """Seed of one fold: the first eight BLAKE2b bytes of ``seed:fold``."""
    digest = hashlib.blake2b(f"{seed}:{fold}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little")


def id_bits(value: Column, dtype: T.DataType) -> Column:
    """The 64-bit pattern of an id; unsigned decimals wrap, nothing goes to double."""
    if isinstance(dtype, T.DecimalType):
        wide = value.cast("decimal(38,0)")
        wrapped = wide - F.lit(str(2**64)).cast("decimal(38,0)")
        return F.when(wide >= F.lit(str(2**63)).cast("decimal(38,0)"), wrapped).otherwise(
            wide
        ).cast("bigint")
    return value.cast("bigint")


def _unsigned(ids: pd.Series) -> np.ndarray:
    if ids.dtype != np.int64:
        raise ValueError("ids must be integers without nulls")
    return ids.to_numpy().view(np.uint64)


def avalanche(state: np.ndarray) -> np.ndarray:
    """Add the increment and mix every bit into every other."""
    state = state + np.uint64(GOLDEN_INCREMENT)
    for shift, factor in _ROUNDS:
        state ^= state >> np.uint64(shift)
        state *= np.uint64(factor)
    return state ^ (state >> np.uint64(_LAST_SHIFT))


def with_pair_uniform(
    df: DataFrame,
    *,
    seed: int,
    fold: str,
    out: str = "uniform",
    user: str = "user_id",
    item: str = "item_id",
) -> DataFrame:
    """Add a reproducible number in [0, 1) for each (user, item) of a fold.

    It depends on the two ids, the seed and the fold only, not on row order or
    partitioning.
    """
    bits = fold_seed(seed, fold)

    @F.pandas_udf(T.DoubleType())
    def uniform(users: pd.Series, items: pd.Series) -> pd.Series:
        state = _unsigned(users) * np.uint64(USER_MULTIPLIER)
        state ^= _unsigned(items) * np.uint64(ITEM_MULTIPLIER)
        state ^= np.uint64(bits)
        return pd.Series((avalanche(state) >> np.uint64(11)) * 2.0**-53)

    return df.withColumn(
        out,
        uniform(
            id_bits(F.col(user), df.schema[user].dataType),
            id_bits(F.col(item), df.schema[item].dataType),
        ),
    )


def with_id_hash(df: DataFrame, *, seed: int, out: str, key: str = "user_id") -> DataFrame:
    """Add a 64-bit hash of one id, shifted so that signed order is unsigned order."""

    @F.pandas_udf(T.LongType())
    def hashed(ids: pd.Series) -> pd.Series:
        state = avalanche(_unsigned(ids) + np.uint64(seed))
        return pd.Series((state ^ np.uint64(_SIGN_BIT)).view(np.int64))

    return df.withColumn(out, hashed(id_bits(F.col(key), df.schema[key].dataType)))
