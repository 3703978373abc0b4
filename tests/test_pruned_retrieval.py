"""Pruned retrieval against brute force, and the blocks it leaves out."""

import numpy as np
import pytest

from morrow.operators.pruned_retrieval import retrieve_pruned

V = "array<double>"


def frames(spark, q, x, seen):
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], f"user_id bigint, features {V}")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"item_id int, features {V}")
    return queries, items, spark.createDataFrame(seen, "user_id bigint, item_id int")


def brute(q, x, seen, k):
    hidden, found = set(seen), []
    for u, v in enumerate(q):
        scores = [(-float(v @ y), i) for i, y in enumerate(x) if (u, i) not in hidden]
        found += [(u, i, rank) for rank, (_, i) in enumerate(sorted(scores)[:k], 1)]
    return found


@pytest.mark.parametrize(("block", "k"), [(5, 3), (16, 20), (1000, 4)])
def test_same_rows_as_brute_force(spark, block, k):
    rng = np.random.default_rng(block)
    # Whole numbers, so that ties are exact; some zero vectors.
    q, x = rng.integers(-2, 3, (12, 3)).astype(float), rng.integers(-3, 4, (60, 3)).astype(float)
    x[7] = q[3] = 0.0
    seen = [(int(u), int(i)) for u, i in zip(rng.integers(0, 14, 80), rng.integers(0, 70, 80), strict=True)]
    found = retrieve_pruned(*frames(spark, q, x, seen), k, "v", block_rows=block)
    rows = sorted((r["user_id"], r["item_id"], r["rank"]) for r in found.rows.collect())
    assert rows == sorted(brute(q, x, seen, k))


def test_short_blocks_are_never_met(spark):
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(8, 4)), rng.normal(size=(200, 4))
    x[20:] *= 0.01  # the first two blocks of ten decide nearly everything
    found = retrieve_pruned(*frames(spark, q, x, [(0, 0)]), 2, "v", block_rows=10)
    rows = sorted((r["user_id"], r["item_id"], r["rank"]) for r in found.rows.collect())
    assert rows == sorted(brute(q, x, [(0, 0)], 2))
    met = {(r["query_block"], r["item_block"]) for r in found.met.collect()}
    assert (found.query_blocks, found.item_blocks) == (1, 20)
    assert max(b for _, b in met) < 7


def test_no_queries_and_no_items(spark):
    q, x = np.ones((2, 2)), np.ones((3, 2))
    queries, items, seen = frames(spark, q, x, [(0, 0)])
    assert retrieve_pruned(queries.limit(0), items, seen, 2, "v").rows.count() == 0
    assert retrieve_pruned(queries, items.limit(0), seen, 2, "v").rows.count() == 0
    assert retrieve_pruned(queries, items, seen.limit(0), 5, "v").rows.count() == 6
