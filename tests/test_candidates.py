import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from morrow.operators import covisit, factors, interactions, popularity, sequences, union
from morrow.operators.covisit import CovisitConfig

HOUR = timedelta(hours=1)


def random_daily(daily, noon, users=12, items=25, n=260, seed=0):
    rng = random.Random(seed)
    seen, out = set(), []
    for _ in range(n):
        user = 1 if rng.random() < 0.34 else rng.randrange(2, users)  # a third for one user
        item, back = rng.randrange(items), rng.randrange(24 * 10)
        dt = noon - timedelta(hours=back, minutes=rng.randrange(1, 60))
        if (user, item, dt.date()) in seen:
            continue
        seen.add((user, item, dt.date()))
        out.append((user, item, dt, rng.randrange(120), int(rng.random() < 0.2), int(rng.random() < 0.1)))
    return out, daily(out)


def test_daily_aggregation_keeps_first_time_and_maximum_flags(spark):
    at = datetime(2024, 1, 1, 10)
    raw = spark.createDataFrame(
        [
            (1, 10, "view", 5, at + HOUR),
            (1, 10, "like", 50, at),
            (1, 10, "view", 61, at + 20 * HOUR),
            (2**53 + 1, 11, "favorite", 0, at),
            (2, 10, "view", 60, at),
        ],
        "user_id bigint, item_id int, event_type string, watch_time bigint, date timestamp_ntz",
    )
    got = rows(interactions.aggregate_daily(raw), "user_id", "dt", "views", "watch_time", "is_like",
               "is_favorite", "is_positive")
    assert got == [
        (1, at, 2, 50, 1, 0, 1),
        (1, at + 20 * HOUR, 1, 61, 0, 0, 1),
        (2, at, 1, 60, 0, 0, 0),
        (2**53 + 1, at, 1, 0, 0, 1, 1),
    ]


def test_split_is_half_open(spark):
    at = datetime(2024, 1, 1)
    raw = spark.createDataFrame([(i, at + i * HOUR) for i in range(6)], "user_id bigint, date timestamp_ntz")
    history, validation = interactions.split_interactions(raw, at + 2 * HOUR, at + 4 * HOUR)
    assert rows(history, "user_id") == [(0,), (1,)]
    assert rows(validation, "user_id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        interactions.split_interactions(raw, at, at)


def test_ground_truth_stages(spark, daily, noon):
    history = daily([(1, 10, noon, 5, 0, 0), (2, 11, noon, 5, 0, 0), (2, 13, noon, 5, 0, 0), (2, 14, noon, 5, 0, 0)])
    later = noon + 24 * HOUR
    validation = daily(
        [
            (1, 10, later, 90, 0, 0),  # already seen
            (1, 12, later, 0, 1, 0),  # cold item
            (1, 13, later, 90, 0, 0),
            (1, 14, later, 5, 0, 0),  # not positive
            (3, 14, later, 0, 0, 1),  # not a target
        ]
    )
    targets = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    truth = interactions.ground_truth(history, validation, targets)
    assert rows(truth.positive, "user_id", "item_id") == [(1, 10), (1, 12), (1, 13), (3, 14)]
    assert rows(truth.unseen, "user_id", "item_id") == [(1, 12), (1, 13), (3, 14)]
    assert rows(truth.cold, "user_id", "item_id") == [(1, 12)]
    assert rows(truth.eligible, "user_id", "item_id") == [(1, 13), (3, 14)]
    assert rows(truth.target, "user_id", "item_id") == [(1, 13)]
    funnel = interactions.truth_funnel(truth, targets).first()
    assert (funnel["positive_unique_pairs"], funnel["seen_pairs_removed"], funnel["cold_pairs_removed"]) == (4, 1, 1)
    assert funnel["target_users"] == 2 and funnel["seen_pair_share_of_positive"] == 0.25


def test_popularity_lists_against_brute_force(spark, daily, noon):
    data, history = random_daily(daily, noon)
    seen = {(u, i) for u, i, *_ in data}
    users = sorted({u for u, *_ in data}) + [99]
    targets = spark.createDataFrame([(u,) for u in users], "user_id bigint")
    ranking = popularity.fit_global_popularity(history, "distinct_interacting_users")
    counts = {i: len({u for u, x in seen if x == i}) for _, i in seen}
    order = sorted(counts, key=lambda i: (-counts[i], i))
    assert [r[0] for r in ranking.orderBy("global_rank").collect()] == order
    got = popularity.recommend_unseen(ranking, interactions.seen_pairs(history), targets, 9, "p")
    expected = []
    for user in users:
        free = [i for i in order if (user, i) not in seen][:9]
        expected += [(user, i, n) for n, i in enumerate(free, 1)]
    assert rows(got, "user_id", "item_id", "rank") == sorted(expected)
    short = {u for u in users if len([i for i in order if (u, i) not in seen]) < 9}
    assert {r[0] for r in popularity.short_users(got, targets, 9).collect()} == short


def test_recency_configuration_is_checked():
    with pytest.raises(ValueError):
        popularity.DecayedViews(0.0)
    with pytest.raises(ValueError):
        popularity.WindowViews(hours=float("inf"))
    with pytest.raises(ValueError):
        popularity.BlendedViews({})
    with pytest.raises(ValueError):
        popularity.TrendingViews(short=5, long=5, smoothing=1)
    assert popularity.WindowViews().grid() == (set(), set())


def brute_pairs(data, config):
    users, links, counts = {}, {}, {}
    for user, item, dt, watch, like, favorite in data:
        old = users.setdefault(user, {}).get(item)
        positive = int(watch > 60 or like or favorite)
        users[user][item] = (max(dt, old[0]), max(positive, old[1])) if old else (dt, positive)
    for items in users.values():
        recent = sorted(items.items(), key=lambda e: (-e[1][0].timestamp(), e[0]))[: config.history_cap]
        if config.profile == "positive":
            recent = [e for e in recent if e[1][1]]
        for item, _ in recent:
            counts[item] = counts.get(item, 0) + 1
        for a in range(len(recent)):
            for b in range(a + 1, len(recent)):
                (new, (t_new, _)), (old, (t_old, _)) = recent[a], recent[b]
                hours = (t_new - t_old).total_seconds() / 3600
                weight = 1.0 if config.pair_weight == "uniform" else 2 ** (-hours / config.pair_half_life_hours)
                if config.direction == "directed":
                    ends = [(old, new)] if t_new > t_old else []
                else:
                    ends = [(old, new), (new, old)]
                for end in ends:
                    w, n = links.get(end, (0.0, 0))
                    links[end] = (w + weight, n + 1)
    return links, counts


@pytest.mark.parametrize("direction", covisit.DIRECTIONS)
@pytest.mark.parametrize("profile", covisit.PROFILES)
@pytest.mark.parametrize("normalization,weight", [("raw", "time_decay"), ("cosine", "uniform"), ("jaccard", "time_decay")])
def test_neighbors_against_brute_force(spark, daily, noon, direction, profile, normalization, weight):
    data, history = random_daily(daily, noon, seed=4)
    config = CovisitConfig(
        profile=profile, direction=direction, normalization=normalization, pair_weight=weight,
        history_cap=6, neighbor_k=4, seed_k=3, min_pair_users=1,
    )
    links, counts = brute_pairs(data, config)
    expected = []
    for item in {a for a, _ in links}:
        scored = []
        for (a, b), (w, n) in links.items():
            if a == item:
                scale = {"raw": 1, "cosine": math.sqrt(counts[a] * counts[b]), "jaccard": counts[a] + counts[b] - n}
                scored.append((round(w / scale[normalization], 9), b, n))
        best = sorted(scored, key=lambda s: (-s[0], s[1]))[:4]
        expected += [(item, b, s, n) for s, b, n in best]
    got = covisit.fit_neighbors(history, config).withColumn("score", F.round("score", 9))
    assert sorted((s, n) for _, _, s, n in rows(got, "item_id", "neighbor_item_id", "score", "co_user_count")) == sorted(
        (s, n) for _, _, s, n in expected
    )
    if weight == "uniform":  # decayed sums may order near ties differently
        assert rows(got, "item_id", "neighbor_item_id", "score", "co_user_count") == sorted(expected)


def test_history_rank_for_a_user_with_most_rows(spark, daily, noon):
    data, history = random_daily(daily, noon, seed=8)
    collapsed = covisit.collapse_history(history)
    latest = {}
    for user, item, dt, *_ in data:
        latest[user, item] = max(dt, latest.get((user, item), dt))
    expected = []
    for user in {u for u, _ in latest}:
        mine = sorted(((i, t) for (u, i), t in latest.items() if u == user), key=lambda e: (-e[1].timestamp(), e[0]))
        expected += [(user, i, n) for n, (i, _) in enumerate(mine, 1)]
    assert rows(covisit.rank_history(collapsed), "user_id", "item_id", "history_rank") == sorted(expected)


def test_covisit_configuration_is_checked():
    with pytest.raises(ValueError):
        CovisitConfig(seed_k=11, history_cap=10)
    with pytest.raises(ValueError):
        CovisitConfig(direction="sideways")
    with pytest.raises(ValueError):
        CovisitConfig().with_seed_options(neighbor_k=5)
    assert CovisitConfig().with_seed_options(seed_k=2).seed_k == 2


def test_retrieval_is_exact_for_any_block_size(spark):
    rng = np.random.default_rng(2)
    items = {i: rng.integers(-3, 4, 4).astype(float) for i in range(40)}  # many equal scores
    users = {u: rng.integers(-3, 4, 4).astype(float) for u in range(15)}
    seen = {(u, int(i)) for u in users for i in rng.choice(40, 37 if u == 3 else 8, replace=False)}
    vectors = "features array<float>"
    q = spark.createDataFrame([(u, v.tolist()) for u, v in users.items()], f"user_id bigint, {vectors}")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in items.items()], f"item_id int, {vectors}")
    s = spark.createDataFrame(sorted(seen), "user_id bigint, item_id int")
    expected = []
    for u, v in users.items():
        free = sorted((-float(v @ items[i]), i) for i in items if (u, i) not in seen)[:5]
        expected += [(u, i, -score, n) for n, (score, i) in enumerate(free, 1)]
    for block in (7, 1000):
        got = factors.retrieve_top(q, c, s, 5, "v", block_rows=block)
        assert rows(got, "user_id", "item_id", "score", "rank") == sorted(expected)


def test_union_provenance_and_fusion(spark):
    schema = "user_id bigint, item_id int, score double, rank int, source string"
    a = spark.createDataFrame([(1, 10, 3.0, 1, "a"), (1, 11, 2.0, 2, "a"), (1, 12, 1.0, 3, "a")], schema)
    b = spark.createDataFrame([(1, 11, -9.0, 1, "b"), (1, 13, -9.5, 2, "b"), (2, 10, 1.0, 1, "b")], schema)
    table = union.build_union({"a": a, "b": b}, union.UnionConfig({"a": 2, "b": 2}, 4))
    got = {(r["user_id"], r["item_id"]): r for r in table.collect()}
    assert set(got) == {(1, 10), (1, 11), (1, 13), (2, 10)}
    both = got[1, 11]
    assert both["source_count"] == 2 and both["generator_score_b"] == -9.0 and both["generator_rank_norm_a"] == 0.5
    missing = got[1, 13]
    assert not missing["generated_by_a"] and missing["generator_rank_a"] == 0 and missing["generator_score_a"] == 0.0
    fusion = union.FusionConfig({"a": 1, "b": 2}, {"a": 1.0, "b": 2.0}, constant=10)
    scores = {(r[0], r[1]): r[2] for r in union.fusion_scores(table, fusion).collect()}
    assert scores == pytest.approx({(1, 10): 1 / 11, (1, 11): 2 / 11, (1, 13): 2 / 12, (2, 10): 2 / 11})
    with pytest.raises(ValueError):
        union.UnionConfig({"a": 3, "b": 2}, 4)


def test_sequences_windows_and_negatives(spark, daily, noon):
    data, history = random_daily(daily, noon, seed=6)
    positive = {}
    for user, item, dt, watch, like, favorite in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        if watch > 60 or like or favorite:
            positive.setdefault(user, []).append(item)
    ordered = sequences.positive_sequences(history)
    got = {}
    for user, _position, item in rows(ordered, "user_id", "position", "item_id"):
        got.setdefault(user, []).append(item)
    assert got == positive
    users = history.select("user_id").distinct()
    context = {r["user_id"]: r["items"] for r in sequences.prediction_context(ordered, users, 4).collect()}
    assert context == {u: positive.get(u, [])[-4:] for u in {r[0] for r in data}}
    seen = interactions.seen_pairs(history)
    lengths = sequences.sequence_lengths(ordered, users)
    ends = sequences.window_ends(sequences.eligible_users(lengths, seen, 25), epoch=1, seed=2, max_length=5)
    windows = sequences.training_windows(ordered, ends)
    for row in windows.collect():
        assert 1 <= len(row["inputs"]) <= 5 and len(row["inputs"]) == len(row["targets"])
        joined = row["inputs"] + row["targets"][-1:]
        assert any(positive[row["user_id"]][i : i + len(joined)] == joined for i in range(len(positive[row["user_id"]])))
    drawn = sequences.unseen_negatives(windows, seen, history, draws=3, epoch=1, seed=2)
    pairs = {(u, i) for u, i, *_ in data}
    out = rows(drawn, "user_id", "target_number", "draw", "item_id")
    assert out and all((u, i) not in pairs for u, _, _, i in out)
    assert len(out) == sum(3 * len(r["targets"]) for r in windows.collect())
