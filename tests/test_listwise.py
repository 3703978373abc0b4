"""The listwise boosted trees against numpy and against the linear group ranker."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morrow.operators import listwise, rankers

SCHEMA = "user_id bigint, group_id bigint, item_id int, label int, a double, b double"


def build(spark, groups=60, size=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        a, b = rng.integers(0, 6, size), rng.normal(size=size)
        # The best row is the one with a middle ``a``, which no linear score can prefer.
        label = (a == 3).astype(int) if (a == 3).any() else np.eye(1, size, 0, dtype=int)[0]
        rows += [(g, g, i, int(label[i]), float(a[i]), float(b[i])) for i in range(size)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def gains_by_hand(rows, borders, l2):
    """Gain of every root split, with zero margins."""
    groups = {}
    for _, g, _, label, *x in rows:
        groups.setdefault(g, []).append((label, x))
    grad, curv, xs = [], [], []
    for members in groups.values():
        y = np.array([label for label, _ in members], float)
        if not y.sum():
            continue
        p = np.full(len(y), 1 / len(y))
        grad += list(p - y / y.sum())
        curv += list(p * (1 - p))
        xs += [x for _, x in members]
    grad, curv, xs = np.array(grad), np.array(curv), np.array(xs)
    worth = lambda m: grad[m].sum() ** 2 / (curv[m].sum() + l2)
    found = {}
    for f, edges in enumerate(borders.values()):
        for cut, edge in enumerate(edges, 1):
            right = xs[:, f] >= edge
            if 0 < right.sum() < len(right):
                found[f, cut] = round(worth(right) + worth(~right) - worth(right | ~right), 9)
    return found


BORDERS = {"a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [-0.5, 0.0, 0.5]}


def test_root_split_by_hand(spark):
    rows, df = build(spark)
    groups = listwise.pack_groups(df, BORDERS)
    cells = listwise.histogram(groups, [], listwise.Tree(), 0, (2, 6))
    found = listwise.split_gains(cells, 1.0).collect()
    expected = gains_by_hand(rows, BORDERS, 1.0)
    assert {(r["feature"], r["bin"]): r["gain"] for r in found} == pytest.approx(expected, abs=2e-9)
    best = listwise.best_splits(listwise.split_gains(cells, 1.0), 0.0).first()
    assert (best["feature"], best["bin"]) == max(expected, key=lambda k: (expected[k], -k[0], -k[1]))


def test_ties_go_to_the_first_feature_and_border(spark):
    rows = [(g, g, i, int(i < 2), float(i // 2), float(i // 2)) for g in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = listwise.fit_listwise_trees(df, {"b": [0.5, 0.7], "a": [0.5]}, listwise.ListwiseConfig(trees=1, depth=1))
    assert model.trees[0].splits == {1: (0, 2)} or model.trees[0].splits == {1: (0, 1)}
    assert model.features[model.trees[0].splits[1][0]] == "b"


@pytest.mark.parametrize("refresh", [2, 100])
def test_trees_beat_the_linear_ranker(spark, refresh):
    _, df = build(spark)
    config = listwise.ListwiseConfig(trees=6, depth=3, step=0.5, refresh=refresh)
    model = listwise.fit_listwise_trees(df, BORDERS, config)
    linear = rankers.fit_group_ranker(df, ["a", "b"], iterations=30, step=1.0)
    mine = listwise.group_loss(df, model.score()).first()["group_loss"]
    theirs = listwise.group_loss(df, linear.score()).first()["group_loss"]
    assert mine < theirs - 0.3
    assert list(model.losses) == sorted(model.losses, reverse=True)
    # The loss of a scan is that of the expression, whether or not margins were written.
    prefix = listwise.group_loss(df, model.truncated(5).score()).first()["group_loss"]
    assert prefix == pytest.approx(model.losses[5], abs=1e-9)


def test_expression_and_node_table_agree_with_the_walk(spark):
    rows, df = build(spark, groups=20)
    odd = spark.createDataFrame([(90, 90, 0, 1, None, float("nan")), (90, 90, 1, 0, float("inf"), 0.5)], SCHEMA)
    df = df.unionByName(odd)
    model = listwise.fit_listwise_trees(df, BORDERS, listwise.ListwiseConfig(trees=3, depth=3, step=0.3))
    nodes = {}
    for r in model.node_table(spark).collect():
        nodes[r["tree"], r["node"]] = r

    def walk(tree, x):
        node = 1
        while nodes[tree, node]["feature"]:
            n = nodes[tree, node]
            v = x[n["feature"]]
            node = 2 * node + int(v is not None and v == v and v >= n["border"])
        return nodes[tree, node]["value"]

    for r in df.select("a", "b", model.score().alias("s")).collect():
        assert r["s"] == pytest.approx(sum(walk(t, {"a": r["a"], "b": r["b"]}) for t in range(3)), abs=1e-12)


def test_groups_without_positives_and_empty_tables(spark):
    _, df = build(spark, groups=5)
    with pytest.raises(ValueError, match="positive"):
        listwise.fit_listwise_trees(df.withColumn("label", F.lit(0)), BORDERS)
    with pytest.raises(ValueError, match="border"):
        listwise.fit_listwise_trees(df, {"a": []})
    lone = df.filter("item_id = 0").withColumn("label", F.lit(1))
    assert listwise.fit_listwise_trees(lone, BORDERS).trees == ()
