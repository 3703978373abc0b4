"""Popularity lists read the seen pairs once."""

import pytest

from morrow.operators import popularity


def rows(df, *names):
    return sorted(tuple(row[n] for n in names) for row in df.collect())


def ranked(spark, items):
    return spark.range(1, items + 1).selectExpr(
        "CAST(id * 10 AS INT) AS item_id", "CAST(100 - id AS DOUBLE) AS score", "id AS global_rank"
    )


@pytest.mark.parametrize("items", [12, 13, 4])
@pytest.mark.parametrize("k", [1, 3, 6])
def test_unseen_items_over_blocks_against_brute_force(spark, monkeypatch, items, k):
    monkeypatch.setattr(popularity, "SEEN_BLOCK", 4, raising=False)
    ranking = ranked(spark, items)
    seen = {
        1: [1, 2, 3, 4], 2: [2, 3, 5, 6, 7, 8, 9], 3: list(range(1, items + 1)), 4: [9, 10, 12],
        5: list(range(1, items)), 6: [1, 5, 6, 7, 8], 7: [77], 9: [1],
    }
    pairs = spark.createDataFrame(
        [(u, p * 10) for u, at in seen.items() for p in at], "user_id bigint, item_id int"
    )
    users = [1, 2, 3, 4, 5, 6, 7, 8]
    targets = spark.createDataFrame([(u,) for u in users], "user_id bigint")
    got = popularity.recommend_unseen(ranking, pairs, targets, k, "p")
    expected = []
    for user in users:
        free = [p for p in range(1, items + 1) if p not in seen.get(user, [])][:k]
        expected += [(user, p * 10, float(100 - p), n) for n, p in enumerate(free, 1)]
    assert rows(got, "user_id", "item_id", "score", "rank") == sorted(expected)
    assert dict(got.dtypes)["rank"] == "int"


def test_an_empty_ranking_gives_no_lists(spark):
    seen = spark.createDataFrame([(1, 10)], "user_id bigint, item_id int")
    got = popularity.recommend_unseen(ranked(spark, 0), seen, seen.select("user_id"), 3, "p")
    assert got.count() == 0


def test_seen_pairs_are_read_once(spark, tmp_path):
    spark.sql("SELECT id % 9 AS user_id, CAST(id * 10 AS INT) AS item_id FROM range(1, 30)").write.parquet(
        f"{tmp_path}/seen-once"
    )
    seen = spark.read.parquet(f"{tmp_path}/seen-once")
    got = popularity.recommend_unseen(ranked(spark, 40), seen, spark.range(9).toDF("user_id"), 3, "p")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [user_id" in line for line in plan.splitlines()) == 1
