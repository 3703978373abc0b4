"""Half steps and fits on given confidences against dense numpy."""

import numpy as np
import pytest

from morrow.operators import confidence_als as als


def make(spark, users=30, items=20, rank=4, seed=1):
    rng = np.random.default_rng(seed)
    kept = rng.random((users, items)) < 0.3
    kept[:, 0] = True  # an item that everybody has
    kept[5:, 19] = False
    conf = np.where(kept, 1 + rng.random((users, items)) * 5, 0.0)
    pairs = spark.createDataFrame(
        [(int(u) + 1000, int(i), float(conf[u, i])) for u, i in zip(*np.nonzero(kept))], "user_id bigint, item_id int, confidence double"
    )
    y = rng.normal(size=(items, rank))
    factors = spark.createDataFrame([(i, y[i].tolist()) for i in range(items)], "item_id int, features array<double>")
    return kept, conf, pairs, y, factors


def dense(kept, conf, y, reg):
    found = []
    for k, c in zip(kept, conf):
        a = y.T @ y + (y[k] * (c[k] - 1)[:, None]).T @ y[k] + reg * np.eye(y.shape[1])
        found.append(np.linalg.solve(a, c[k] @ y[k]))
    return np.array(found)


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_half_step_solves_the_normal_equations(spark, block_rows):
    kept, conf, pairs, y, factors = make(spark)
    config = als.ConfidenceAlsConfig(rank=4, regularization=0.1, steps=4, block_rows=block_rows)
    rows = als.half_step(pairs, "user_id", "item_id", factors, config).collect()
    mine = np.array([r["features"] for r in sorted(rows)])
    assert mine == pytest.approx(dense(kept, conf, y, 0.1), abs=1e-6)


def test_a_hot_entity_is_spread_over_blocks(spark):
    _, conf, pairs, y, factors = make(spark)
    turned = pairs.selectExpr("item_id AS entity", "user_id AS other", "confidence")
    vectors = spark.createDataFrame([(u + 1000, [1.0, float(u)]) for u in range(30)], "other bigint, features array<double>")
    sums = {r["entity"]: r for r in als.entity_sums(turned, vectors, 2, 4).collect()}
    assert len(sums) == turned.select("entity").distinct().count()
    hot = conf[:, 0]
    rows = np.stack([np.ones(30), np.arange(30.0)], axis=1)
    assert sums[0]["matrix"] == pytest.approx(((rows * (hot - 1)[:, None]).T @ rows).ravel())
    assert sums[0]["target"] == pytest.approx(hot @ rows)


def test_fit_lowers_the_objective_and_is_reproducible(spark):
    _, _, pairs, _, _ = make(spark)
    config = als.ConfidenceAlsConfig(rank=3, iterations=1, regularization=0.05, steps=3)
    losses = []
    for n in (1, 3):
        fit = als.fit_confidence_als(pairs, als.ConfidenceAlsConfig(**{**config.__dict__, "iterations": n}))
        losses.append(als.objective(pairs, fit, config))
    again = als.fit_confidence_als(pairs.repartition(7), als.ConfidenceAlsConfig(**{**config.__dict__, "iterations": 3}))
    assert losses[1] < losses[0]
    mine, same = ({r["user_id"]: r["features"] for r in f.user_factors.collect()} for f in (fit, again))
    assert mine.keys() == same.keys()
    assert all(mine[u] == pytest.approx(same[u], abs=1e-8) for u in mine)


def test_objective_counts_every_pair(spark):
    kept, conf, pairs, y, factors = make(spark, users=6)
    x = np.random.default_rng(2).normal(size=(6, 4))
    users = spark.createDataFrame([(u + 1000, x[u].tolist()) for u in range(6)], "user_id bigint, features array<double>")
    config = als.ConfidenceAlsConfig(rank=4, regularization=0.2)
    score = x @ y.T
    plain = np.where(kept, conf * (1 - score) ** 2, score**2).sum() + 0.2 * ((x**2).sum() + (y**2).sum())
    assert als.objective(pairs, als.ConfidenceFactors(users, factors), config) == pytest.approx(plain)


def test_unknown_others_and_empty_tables(spark):
    _, _, pairs, _, factors = make(spark)
    config = als.ConfidenceAlsConfig(rank=4, steps=4)
    only = factors.filter("item_id = 19")
    assert als.half_step(pairs, "user_id", "item_id", only, config).count() == pairs.filter("item_id = 19").count()
    assert als.half_step(pairs.limit(0), "user_id", "item_id", factors, config).count() == 0
