"""A query of the factor norms does not pay for the history features."""

from checks.fixtures import World


def test_norms_are_built_without_the_history_features(spark):
    world = World(spark, "/root/testdata/sf0.001")
    assert world.lookups["als_user_norms"].count() > 0
    assert world.lookups["als_item_norms"].count() > 0
    assert sorted(world.lookups.stored) == ["als_item_norms", "als_user_norms"]
    assert "history" not in vars(world)
    assert list(world.lookups) == ["user_features", "item_features", "als_user_norms", "als_item_norms"]
    assert world.lookups["item_features"] is world.lookups["item_features"]
