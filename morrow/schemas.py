"""Table contracts.

Unsigned source types map to the next wider signed Spark type.  ``user_id`` is
``BIGINT`` when every id fits and ``DECIMAL(20,0)`` when parquet delivers
unsigned 64-bit ids; both are accepted wherever a user id is expected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

USER_ID_TYPES = (T.LongType(), T.DecimalType(20, 0))


class ContractError(ValueError):
    """A table does not satisfy its declared contract."""



def contract(**columns: T.DataType) -> dict[str, T.DataType]:
    return dict(columns)


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()

RAW_INTERACTION = contract(
    user_id=_LONG,
    item_id=_INT,
    event_type=T.StringType(),
    watch_time=_LONG,
    date=T.TimestampNTZType(),
)
TARGET_USER = contract(user_id=_LONG)
DAILY_INTERACTION = contract(
    user_id=_LONG,
    item_id=_INT,
    date=T.DateType(),
    dt=T.TimestampNTZType(),
    views=_LONG,
    watch_time=_LONG,
    is_like=_INT,
    is_favorite=_INT,
    is_positive=_INT,
)
PAIR = contract(user_id=_LONG, item_id=_INT)
CANDIDATE = contract(
    user_id=_LONG, item_id=_INT, score=_DOUBLE, rank=_INT, source=T.StringType()
)
RANKER_OUTPUT = contract(user_id=_LONG, item_id=_INT, ranker_score=_DOUBLE)
RECOMMENDATION = contract(user_id=_LONG, item_ids=T.ArrayType(_INT))
ITEM_POPULARITY = contract(
    item_id=_INT,
    raw_interaction_count=_LONG,
    distinct_interacting_users=_LONG,
    relevant_interaction_count=_LONG,
    distinct_relevant_users=_LONG,
)
ITEM_RANKING = contract(item_id=_INT, score=_DOUBLE, global_rank=_LONG)
COLLAPSED_HISTORY = contract(
    user_id=_LONG,
    item_id=_INT,
    last_dt=T.TimestampNTZType(),
    views=_LONG,
    watch_time=_LONG,
    is_like=_INT,
    is_favorite=_INT,
    is_positive=_INT,
)
NEIGHBOR = contract(
    item_id=_INT, neighbor_item_id=_INT, score=_DOUBLE, co_user_count=_LONG, rank=_INT
)

PAIR_KEYS = ["user_id", "item_id"]
DAILY_KEYS = ["user_id", "item_id", "date"]


def differences(df: DataFrame, expected: dict[str, T.DataType]) -> list[str]:
    """Describe every way in which a schema departs from a contract."""
    actual = {field.name: field.dataType for field in df.schema.fields}
    problems = [f"missing column {name}" for name in expected if name not in actual]
    problems += [f"unexpected column {name}" for name in actual if name not in expected]
    for name, wanted in expected.items():
        found = actual.get(name)
        allowed = USER_ID_TYPES if name == "user_id" else (wanted,)
        if found is not None and not any(_same_type(found, a) for a in allowed):
            problems.append(
                f"{name} is {found.simpleString()}, not {wanted.simpleString()}"
            )
    return problems


def _same_type(left: T.DataType, right: T.DataType) -> bool:
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return left.elementType == right.elementType
    return left == right


def require(df: DataFrame, expected: dict[str, T.DataType], name: str) -> DataFrame:
    """Return the frame unchanged, or fail when its schema breaks the contract."""
    problems = differences(df, expected)
    if problems:
        raise ContractError(f"{name}: " + "; ".join(problems))
    return df


def require_columns(df: DataFrame, names: Iterable[str], name: str) -> DataFrame:
    """Check that the named columns exist, ignoring any others."""
    missing = [column for column in names if column not in df.columns]
    if missing:
        raise ContractError(f"{name}: missing columns {missing}")
    return df
