"""Sums of a confidence half step go on over the batches of a partition."""

import numpy as np
import pandas as pd
import pytest

from morrow.operators import confidence_als


def test_block_sums_of_sorted_rows_go_on_over_batches():
    rng = np.random.default_rng(3)
    keys = [(1, 0)] * 3 + [(1, 1)] * 2 + [(2, 0)] * 4 + [(7, 0)]
    vectors, weight = rng.normal(size=(len(keys), 2)), rng.random(len(keys)) * 4
    whole = pd.DataFrame(keys, columns=["entity", "block"]).assign(confidence=weight, features=list(vectors))
    batches = [whole[:2], whole[2:2], whole[2:6], whole[6:8], whole[8:]]
    got = pd.concat(confidence_als._block_sums(2)(iter(batches)))
    assert got["entity"].tolist() == [1, 1, 2, 7]
    for row, key in zip(got.itertuples(), dict.fromkeys(keys)):
        mine = [k == key for k in keys]
        y, c = vectors[mine], weight[mine]
        assert row.matrix == pytest.approx(((y * (c - 1)[:, None]).T @ y).ravel())
        assert row.target == pytest.approx(c @ y)
    assert list(confidence_als._block_sums(2)(iter([]))) == []
