import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from morrow.session import local_session  # noqa: E402

DAILY = (
    "user_id bigint, item_id int, date date, dt timestamp_ntz, views bigint, watch_time bigint,"
    " is_like int, is_favorite int, is_positive int"
)


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=4, memory="4g", partitions="4")


@pytest.fixture()
def shuffled(spark):
    """A session in which no side of a join is small enough to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield spark
    for name, value in old.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


@pytest.fixture()
def daily(spark):
    """Build daily rows from (user, item, datetime, watch_time, like, favorite)."""

    def build(rows, views=1):
        full = []
        for user, item, dt, watch, like, favorite in rows:
            positive = int(watch > 60 or like == 1 or favorite == 1)
            full.append((user, item, dt.date(), dt, views, watch, like, favorite, positive))
        return spark.createDataFrame(full, DAILY)

    return build


@pytest.fixture()
def noon():
    return datetime(2024, 1, 10, 12)


def rows(df, *names):
    return sorted(tuple(row[n] for n in names) for row in df.collect())
