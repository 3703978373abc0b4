import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from morrow.functions.hashing import fold_seed, with_id_hash, with_pair_uniform
from morrow.functions.joins import lookup_join
from morrow.functions.missing import nth_unseen, unseen_before
from morrow.functions.ranking import (
    bucketed_rank,
    global_rank,
    nearest_quantiles,
    order_breaks,
    top_rows,
)
from morrow.functions.vectors import dot, non_finite, norm, unit

MASK = 2**64 - 1


def mixed(value):
    value = (value + 0x9E3779B97F4A7C15) & MASK
    value = ((value ^ value >> 30) * 0xBF58476D1CE4E5B9) & MASK
    value = ((value ^ value >> 27) * 0x94D049BB133111EB) & MASK
    return value ^ value >> 31


def test_pair_uniform_matches_integers_of_any_size(spark):
    ids = [0, 1, 2**53 + 123, 2**63 - 1, 2**63, 2**64 - 1]
    pairs = [(str(u), i) for u in ids for i in (-5, 0, 7, 2**31 - 1)]
    df = spark.createDataFrame(pairs, "u string, item_id int").select(
        F.col("u").cast("decimal(20,0)").alias("user_id"), "item_id"
    )
    got = {
        (int(r["user_id"]), r["item_id"]): r["uniform"]
        for r in with_pair_uniform(df, seed=42, fold="f").collect()
    }
    for user in ids:
        for item in (-5, 0, 7, 2**31 - 1):
            state = user * 0xD6E8FEB86659FD93 & MASK
            state ^= (item & MASK) * 0xA5A3564E27F8862F & MASK
            state ^= fold_seed(42, "f")
            assert got[user, item] == (mixed(state) >> 11) / 2**53


def test_pair_uniform_is_independent_of_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("user_id"), F.lit(3).alias("item_id"))
    one = rows(with_pair_uniform(df.coalesce(1), seed=1, fold="x"), "user_id", "uniform")
    many = rows(with_pair_uniform(df.repartition(7), seed=1, fold="x"), "user_id", "uniform")
    assert one == many
    assert 0.4 < np.mean([u for _, u in one]) < 0.6


def test_filters_on_the_hash_keep_a_small_plan(spark):
    df = spark.range(10).select(F.col("id").alias("user_id"), F.lit(3).alias("item_id"))
    sampled = with_pair_uniform(df, seed=1, fold="x").filter(F.col("uniform") < 0.5)
    assert len(sampled._jdf.queryExecution().executedPlan().toString()) < 5000


def test_id_hash_orders_like_unsigned_integers(spark):
    df = spark.range(200).withColumnRenamed("id", "user_id")
    hashed = with_id_hash(df, seed=9, out="h").orderBy("h").collect()
    assert [r["user_id"] for r in hashed] == sorted(range(200), key=lambda u: mixed(u + 9))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_with_a_hot_key_equals_a_plain_join(shuffled, how):
    spark = shuffled
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    right = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined, plain = lookup_join(left, right, "k", how), left.join(right, "k", how)
    assert joined.columns == plain.columns
    assert rows(joined.na.fill(-1), *plain.columns) == rows(plain.na.fill(-1), *plain.columns)
    assert "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()


def test_chained_lookups_read_each_side_once(shuffled):
    spark = shuffled
    df = spark.range(100).withColumnRenamed("id", "k")
    chain = df
    for i in range(6):
        chain = lookup_join(chain, spark.range(50).select(F.col("id").alias("k"), F.lit(i).alias(f"v{i}")), "k")
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 7


def test_ranks_agree_with_sorting(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(40), i) for i in range(600)]
    df = spark.createDataFrame(data, "g int, v int, id int")
    order = [F.desc("v"), F.asc("id")]
    expected = []
    for g in (1, 2, 3):
        ordered = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        expected += [(g, r[2], n) for n, r in enumerate(ordered, 1)]
    ranked = bucketed_rank(df, "g", F.floor(F.col("v") / 7), order, "n", descending=True)
    assert rows(ranked, "g", "id", "n") == sorted(expected)
    for k in (5, 1500):
        top = top_rows(df, "g", order, k, "n")
        assert rows(top, "g", "id", "n") == sorted(r for r in expected if r[2] <= k)
    everything = sorted(data, key=lambda r: (-r[1], r[2]))
    placed = global_rank(df, order, "n")
    assert rows(placed, "id", "n") == sorted((r[2], n) for n, r in enumerate(everything, 1))


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = top_rows(df, "g", [F.asc("id")], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_nearest_quantiles(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "n int")
    assert nearest_quantiles(df, "n", {"p50": 0.5, "p90": 0.9}).first() == (1, 2)
    rng = random.Random(3)
    values = [rng.randrange(30) for _ in range(101)]
    got = nearest_quantiles(spark.createDataFrame([(v,) for v in values], "n int"), "n", {"q": 0.37})
    assert got.first()["q"] == sorted(values)[int(100 * 0.37 + 0.5)]


def test_order_breaks_across_buckets(spark):
    keys = [1, 2, 2, 1, 5, 4, 4, 9]
    df = spark.createDataFrame(list(enumerate(keys)), "p bigint, k int").repartition(3)
    for size in (1, 2, 3, 100):
        assert order_breaks(df, ["k"], "p", bucket_rows=size).first() == (2, 2)


def test_nth_unseen_against_brute_force(spark):
    rng = random.Random(5)
    size = 300
    seen = {u: sorted(rng.sample(range(1, size + 1), n)) for u, n in ((1, 0), (2, 40), (3, 299), (4, 150))}
    asked = {u: [rng.randint(1, size - len(s)) for _ in range(30)] for u, s in seen.items()}
    gaps = unseen_before(
        spark.createDataFrame([(u, p) for u, s in seen.items() for p in s], "user_id bigint, position bigint")
    )
    requests = spark.createDataFrame(
        [(u, n, i) for u, ns in asked.items() for i, n in enumerate(ns)],
        "user_id bigint, ordinal bigint, tag int",
    )
    expected = []
    for user, ordinals in asked.items():
        free = [p for p in range(1, size + 1) if p not in seen[user]]
        expected += [(user, i, free[n - 1]) for i, n in enumerate(ordinals)]
    assert rows(nth_unseen(gaps, requests), "user_id", "tag", "position") == sorted(expected)


def test_nth_unseen_over_many_blocks(spark):
    seen = spark.range(1, 20001).filter(F.col("id") % 2 == 1).select(
        F.lit(7).cast("bigint").alias("user_id"), F.col("id").alias("position")
    )
    asked = spark.createDataFrame([(7, n) for n in (1, 4096, 4097, 9999)], "user_id bigint, ordinal bigint")
    got = nth_unseen(unseen_before(seen), asked)
    assert rows(got, "ordinal", "position") == [(1, 2), (4096, 8192), (4097, 8194), (9999, 19998)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, float("nan")])],
                               "a array<float>, b array<float>")
    out = df.select(dot("a", "b"), norm("a"), unit("a"), non_finite("b")).collect()
    assert tuple(out[0]) == (11.0, 5.0, [0.6, 0.8], False)
    assert out[1][2] is None and out[1][3] is True
