"""Sides that grow with the log never pass through the driver."""

from datetime import datetime

import pytest

from checks.fixtures import World
from morrow.operators import covisit, features, union

CONFIG = covisit.CovisitConfig(neighbor_k=20, seed_k=5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_path):
    """Union, seeds and neighbors as files, far below the broadcast limit."""

    def build(name, sql):
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    pairs = build("pairs", "SELECT id AS user_id, CAST(id % 7 AS INT) AS item_id FROM range(50)")
    seeds = build(
        "seeds",
        "SELECT id AS user_id, CAST(id % 5 AS INT) AS item_id, TIMESTAMP_NTZ'2024-01-01' AS last_dt,"
        " 1 AS history_rank FROM range(50)",
    )
    neighbors = build(
        "neighbors",
        "SELECT CAST(id AS INT) AS item_id, CAST(n AS INT) AS neighbor_item_id, 0.5D AS score,"
        " 2L AS co_user_count, CAST(n + 1 AS INT) AS rank FROM range(5) LATERAL VIEW explode(sequence(0, 19)) AS n",
    )
    return pairs, seeds, neighbors


def test_exploded_evidence_is_not_broadcast(stored):
    pairs, seeds, neighbors = stored
    reached = covisit.seed_contributions(seeds, neighbors, CONFIG, datetime(2024, 1, 2))
    for joined in (
        features.attach_covisit_features(pairs, reached),
        union.attach_covisit(pairs, seeds, neighbors, CONFIG, datetime(2024, 1, 2)),
    ):
        assert "SortMergeJoin [user_id" in plan(joined)
        assert "BroadcastHashJoin [user_id" not in plan(joined)
        assert joined.count() == 50
    found = features.attach_covisit_features(pairs, reached).filter("covisit_available").count()
    assert found == 50


def test_wide_user_features_are_not_broadcast(spark, stored):
    pairs, _, _ = stored
    users = spark.range(50).selectExpr("id AS user_id", "id AS user_views_all")
    items = spark.range(7).selectExpr("CAST(id AS INT) AS item_id", "id AS item_views_all")
    joined = features.attach_history_features(pairs, users, items)
    assert "SortMergeJoin [user_id" in plan(joined)
    assert joined.filter("user_views_all = user_id AND item_views_all = item_id").count() == 50


def test_a_source_is_predicted_without_the_others(spark):
    world = World(spark, "/root/testdata/sf0.001")
    world.seeds  # noqa: B018
    assert world.sources.stored == {} and "global_ranking" not in vars(world)
    assert world.sources["item2item"].count() > 0
    assert list(world.sources.stored) == ["item2item"] and "user_factors" not in vars(world)
    assert list(world.sources) == ["global_popularity", "recency_popularity", "item2item", "implicit_als"]


def test_given_vectors_are_stored_once(spark):
    """Else each of their many readers parses the JSON of all events again."""
    world = World(spark, "/root/testdata/sf0.001")
    for factors in (world.user_factors, world.item_factors):
        assert "Join" not in plan(factors)
