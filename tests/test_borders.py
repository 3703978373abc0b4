"""Weighted bin borders against brute force, and the error of merged summaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morrow.operators import borders, rankers


def expected(values, weights, bins):
    kept = [(v, w) for v, w in zip(values, weights) if v is not None and v == v and w and w > 0]
    if not kept:
        return []
    distinct = sorted({v for v, _ in kept})
    total = sum(w for _, w in kept)
    upto = [sum(w for v, w in kept if v <= d) for d in distinct]
    found = {next(d for d, c in zip(distinct, upto) if c * bins >= i * total) for i in range(1, bins)}
    return sorted(found - {distinct[0]})


@pytest.mark.parametrize("segment_rows", [5, 1 << 16])
def test_borders_are_exact_up_to_size_values(spark, segment_rows):
    rng = np.random.default_rng(7)
    rows = [
        (
            float(rng.integers(0, 60)), float(rng.choice([0.0, 1.0, 9.0], p=[0.9, 0.05, 0.05])), 3.0, None,
            [None, float("nan"), 2.5, -1.0][rng.integers(0, 4)], [None, 0, 1, 2, 7][rng.integers(0, 5)],
        )
        for _ in range(400)
    ]
    names = ["wide", "heavy", "single", "unknown", "holes"]
    schema = ", ".join(f"{n} double" for n in names) + ", w int"
    table = spark.createDataFrame(rows, schema)
    found = borders.weighted_borders(table, names, 8, "w", segment_rows=segment_rows).collect()
    weights = [r[-1] for r in rows]
    assert {r.feature: r.borders for r in found} == {
        n: expected([r[k] for r in rows], weights, 8) for k, n in enumerate(names)
    }
    empty = borders.weighted_borders(table.limit(0), names, 8).collect()
    assert sorted((r.feature, r.borders) for r in empty) == sorted((n, []) for n in names)


def test_merged_summaries_keep_the_stated_error(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    weights = borders.value_weights(lines, ["l_extendedprice", "l_quantity"], "l_quantity")
    size = 64
    summary, levels = borders.merged_summaries(weights, size, segment_rows=1 << 12)
    assert levels > 2
    rows = summary.toPandas()
    assert rows.groupby("feature").size().max() <= 2 * size + 1
    exact = weights.toPandas()
    for name, part in rows.groupby("feature"):
        truth = exact[exact.feature == name].sort_values("value")
        part = part.sort_values("value")
        assert part.weight.sum() == pytest.approx(truth.weight.sum())
        reach = np.append(0, part.weight.cumsum().to_numpy())
        found = reach[np.searchsorted(part.value.to_numpy(), truth.value.to_numpy(), side="right")]
        error = np.abs(found - truth.weight.cumsum().to_numpy()).max() / truth.weight.sum()
        assert error <= (0 if len(truth) <= size else 2 * levels / size)


def test_borders_of_one_fold_bin_another(spark):
    """Borders come from the training fold alone; features without one are ignored."""
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "a double, b double")
    other = spark.createDataFrame([(0.0, 7.0), (2.0, 8.0), (99.0, 9.0)], "a double, b double")
    learned = rankers.border_lists(borders.weighted_borders(train, ["a", "b"], 2))
    assert learned == {"a": [2.0], "b": []}
    binned = rankers.apply_borders(other, learned)
    assert binned.columns == ["bin_a"]
    assert sorted(r.bin_a for r in binned.collect()) == [0.0, 1.0, 1.0]


def test_refused_parameters(spark):
    rows = spark.range(3).select(F.col("id").alias("a"))
    with pytest.raises(ValueError):
        borders.weighted_borders(rows, ["a"], 1)
    with pytest.raises(ValueError):
        borders.merged_summaries(borders.value_weights(rows, ["a"]), size=1)
