from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from morrow.operators import comparison, features, metrics, popularity, profiles, quality, rankers, sampling
from morrow.plans.rows import frozen_features
from morrow.schemas import ContractError
from morrow.sources import tables, text

VECTORS = "features array<float>"


def test_window_features(daily, noon):
    history = daily(
        [
            (1, 10, noon - timedelta(hours=2), 90, 0, 0),
            (1, 11, noon - timedelta(hours=10), 30, 1, 0),
            (1, 10, noon - timedelta(hours=30), 10, 0, 0),
        ],
        views=2,
    )
    row = features.user_features(history, noon).first()
    assert row["user_daily_rows_all"] == 3 and row["user_distinct_items_all"] == 2
    assert row["user_active_days_all"] == 2 and row["user_views_6h"] == 2
    assert row["user_distinct_items_24h"] == 2 and row["user_like_rows_6h"] == 0
    assert row["user_watch_time_mean_24h"] == 60.0 and row["user_watch_time_max_72h"] == 90
    assert row["user_hours_since_last_interaction"] == 2.0 and row["user_hours_since_last_like"] == 10.0
    assert row["user_last_favorite_available"] is False and row["user_hours_since_last_favorite"] == 0.0
    item = {r["item_id"]: r for r in features.item_features(history, noon).collect()}[10]
    assert item["item_daily_rows_24h"] == 1 and item["item_daily_rows_prev_24h"] == 1
    assert item["item_trend_daily_rows_log_ratio_24h"] == 0.0
    assert item["item_trend_views_log_ratio_6h"] == pytest.approx(np.log(3), rel=1e-6)


def test_window_edges_are_half_open(daily, noon):
    history = daily([(1, 1, noon - timedelta(hours=6), 1, 0, 0), (1, 2, noon - timedelta(hours=12), 1, 0, 0)])
    item = {r["item_id"]: r for r in features.item_features(history, noon).collect()}
    assert item[1]["item_daily_rows_6h"] == 1 and item[1]["item_daily_rows_prev_6h"] == 0
    assert item[2]["item_daily_rows_6h"] == 0 and item[2]["item_daily_rows_prev_6h"] == 1


def test_score_ranks_skip_unavailable(spark):
    schema = "user_id bigint, item_id int, cross_score_s double, cross_score_available_s boolean"
    df = spark.createDataFrame([(1, 1, -2.0, True), (1, 2, 0.0, False), (1, 3, -1.0, True)], schema)
    out = features.attach_score_ranks(df, ["s"])
    assert rows(out, "item_id", "union_rank_cross_score_s", "union_rank_norm_cross_score_s") == [
        (1, 2, 0.5), (2, 0, 0.0), (3, 1, 1.0),
    ]


def test_precision_and_candidate_metrics(spark):
    big = 2**53 + 123
    targets = spark.createDataFrame([(big,), (2,), (3,)], "user_id bigint")
    truth = spark.createDataFrame([(big, 10), (big, 11), (2, 13)], "user_id bigint, item_id int")
    lists = spark.createDataFrame([(big, [10, 99]), (2, [13, None]), (3, [])], "user_id bigint, item_ids array<int>")
    row = metrics.precision_at_20(lists, truth, targets).first()
    assert row["final_hits"] == 2
    assert row["precision_at_20_all_targets"] == pytest.approx(2 / 60)
    assert row["precision_at_20_labeled_users"] == pytest.approx(2 / 40)
    candidates = spark.createDataFrame(
        [(big, 10), (big, 10), (big, 11), (2, 20), (3, 1)], "user_id bigint, item_id int"
    )
    out = metrics.candidate_metrics(candidates, truth, targets).first()
    assert out["candidate_recall"] == pytest.approx(2 / 3)
    assert out["candidate_user_hit_rate"] == 0.5
    assert out["candidate_oracle_p20_all_targets"] == pytest.approx(2 / 60)
    assert out["candidate_oracle_p20_labeled_users"] == pytest.approx(2 / 40)
    assert out["mean_candidate_count"] == pytest.approx(4 / 3) and out["p50_candidate_count"] == 1
    none = spark.createDataFrame([], "user_id bigint, item_id int")
    assert metrics.candidate_metrics(none, none, targets).first()["candidate_recall"] == 0.0


def test_list_precision(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 1]), ([1, 2, 3], [3]), ([], [1])], "p array<int>, t array<int>")
    assert [r[0] for r in df.select(metrics.list_precision("p", "t", 2)).collect()] == [0.5, 0.0, 0.0]


def test_overlap_is_null_where_undefined(spark):
    pairs = "user_id bigint, item_id int"
    left = spark.createDataFrame([(1, 1), (1, 2)], pairs)
    right = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], pairs)
    truth = spark.createDataFrame([(1, 2)], pairs)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    out = metrics.overlap_report(metrics.overlap_counts(left, right, truth, users)).first()
    assert out["micro_jaccard"] == 0.25 and out["shared_positive_hits"] == 1
    assert out["jaccard_defined_users"] == 2 and out["jaccard_undefined_users"] == 1
    assert out["share_left_in_right_mean"] == 0.5 and out["share_left_in_right_defined_users"] == 1


def labeled(spark):
    schema = (
        "user_id bigint, item_id int, label smallint, source_count smallint, generated_by_item2item boolean,"
        " generator_rank_item2item int, generated_by_implicit_als boolean, generator_rank_implicit_als int"
    )
    data = [
        (1, 1, 1, 1, False, 0, False, 0),
        (1, 2, 0, 2, False, 0, False, 0),
        (1, 3, 0, 2, True, 9, False, 0),
        (1, 4, 0, 1, True, 50, False, 0),
        (1, 5, 0, 1, False, 0, True, 7),
        (1, 6, 0, 1, True, 51, False, 0),
    ]
    return spark.createDataFrame(data, schema)


def test_strata_and_sampling(spark):
    out = sampling.sample_negatives(labeled(spark), "f", sampling.NegativeSampling(easy_probability=0.3))
    got = out.select("item_id", sampling.training_stratum().alias("s"), "is_hard_negative", "is_training_sample",
                     F.round("sampling_probability", 6).alias("p"))
    found = {r["item_id"]: tuple(r)[1:] for r in got.collect()}
    names = ["positive", "multi_other", "multi_collaborative_top50", "single_item2item_top50", "single_als_top50"]
    assert [found[i][0] for i in range(1, 7)] == [*names, "easy_negative"]
    assert [found[i][1] for i in range(1, 7)] == [False, True, True, True, True, False]
    assert all(found[i][2] for i in range(1, 6)) and found[6][3] == pytest.approx(0.3)


def test_second_stage_weights(spark):
    rows_ = sampling.sample_negatives(labeled(spark), "f", sampling.NegativeSampling(easy_probability=1.0))
    out = sampling.second_stage(rows_, fold="f", seed=1, negative_probability=0.5, features=["source_count"])
    weights = {r["item_id"]: r["sample_weight"] for r in out.collect()}
    assert weights.pop(1) == 1.0 and set(weights.values()) <= {2.0}


def test_allocation(spark):
    counts = spark.createDataFrame([("a", 10, 100), ("b", 20, 30)], "fold string, positives bigint, rows bigint")
    out = sampling.allocate_probabilities(counts, 81, ("a", "b"))
    assert rows(out, "fold", "target_rows", "secondary_negative_probability") == [
        ("a", 41, pytest.approx(31 / 90)), ("b", 30, 1.0),
    ]
    assert rows(sampling.infeasible_allocations(counts, 40, ("a", "b")), "fold") == [("b",)]


def test_remainder_goes_to_the_first_listed_fold(spark):
    counts = spark.createDataFrame(
        [(f, s, n) for f in ("rolling_1", "canonical") for s, n in (("positive", 5), ("easy_negative", 50))],
        "fold string, sampling_stratum string, rows bigint",
    )
    plan = sampling.sampling_plan(counts, 41, ("rolling_1", "canonical"))
    assert {(r["fold"], r["target_rows"]) for r in plan.collect()} == {("rolling_1", 21), ("canonical", 20)}


@pytest.mark.parametrize("target", [8, 400])
def test_infeasible_probabilities_never_become_weights(spark, target):
    counts = spark.createDataFrame(
        [("canonical", s, n) for s, n in (("positive", 10), ("easy_negative", 50))],
        "fold string, sampling_stratum string, rows bigint",
    )
    assert rows(sampling.infeasible_plan(counts, target, ("canonical",)), "fold") == [("canonical",)]
    with pytest.raises(Exception, match="infeasible sampling probability of fold canonical"):
        sampling.sampling_plan(counts, target, ("canonical",)).collect()


def test_profiles_do_not_depend_on_the_basis(spark, daily, noon):
    rng = np.random.default_rng(0)
    factors = rng.normal(size=(6, 4))
    factors[5] = 0
    rotation, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    history = daily([(1, i, noon, 90 if i % 2 else 10, i % 2, 1) for i in range(6)] + [(2, 5, noon, 90, 0, 0)])
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    pairs = profiles.history_pairs(history, users)
    out = []
    for table in (factors, factors @ rotation):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], f"item_id int, {VECTORS}")
        made = profiles.build_profiles(pairs, users, frame)
        candidates = spark.createDataFrame([(1, 0), (1, 5), (2, 0), (3, 1)], "user_id bigint, item_id int")
        table_ = profiles.profile_features(candidates, made, frame).orderBy("user_id", "item_id").collect()
        out.append([list(r)[2:] for r in table_])
    np.testing.assert_allclose(out[0], out[1], atol=1e-5)
    zero_item, no_direction, no_history = out[0][1], out[0][2], out[0][3]
    assert zero_item[0] == 0 and zero_item[4] == 0 and no_direction[1] == 0 and no_history == [0.0] * 20
    unit = factors[:5] / np.linalg.norm(factors[:5], axis=1)[:, None]
    liked = unit[[1, 3]].mean(axis=0)
    like = profiles.PROFILE_KINDS.index("like") * 5
    assert out[0][0][like] == pytest.approx(unit[0] @ liked / np.linalg.norm(liked), abs=1e-5)
    assert out[0][0][like + 1] == pytest.approx(np.linalg.norm(liked), abs=1e-5)


def ranker_data(spark, users=40, items=12):
    rng = np.random.default_rng(1)
    data = []
    for user in range(users):
        signal = rng.normal(size=items)
        best = int(np.argmax(signal + 0.1 * rng.normal(size=items)))
        data += [(user, user, i, int(i == best), 1.0, float(signal[i]), float(rng.normal())) for i in range(items)]
    schema = "user_id bigint, group_id bigint, item_id int, label int, sample_weight double, good double, noise double"
    return spark.createDataFrame(data, schema)


def test_group_ranker_learns_the_signal(spark):
    df = ranker_data(spark)
    model = rankers.fit_group_ranker(df, ["good", "noise"], iterations=15, step=2.0)
    assert model.losses[0] == pytest.approx(np.log(12)) and model.losses[-1] < 0.6 * model.losses[0]
    assert list(model.losses) == sorted(model.losses, reverse=True)
    assert model.weights[0] > 5 * abs(model.weights[1])


def test_tree_prefixes_end_in_the_full_model(spark):
    df = ranker_data(spark)
    model = rankers.fit_trees(df, ["good", "noise"], rankers.TreeConfig(trees=4, depth=2, step=0.3))
    margins = rankers.prefix_scores(model, df, [1, 4]).join(
        rankers.predict_trees(model, df).select("user_id", "item_id", "ranker_score"), ["user_id", "item_id"]
    )
    assert margins.filter(F.abs(F.col("margin_4") - F.col("ranker_score")) > 1e-9).count() == 0
    users = df.select("user_id").distinct()
    truth = df.filter("label = 1").select("user_id", "item_id")
    curve = rankers.prefix_curve(rankers.prefix_scores(model, df, [1, 4]), truth, users, [1, 4], k=1)
    found = {r["tree_count"]: r for r in curve.collect()}
    assert found[4]["full_candidate_logloss"] < found[1]["full_candidate_logloss"]
    assert found[4]["candidate_rows"] == 480 and found[4]["target_users"] == 40
    importance = rankers.feature_importance(model, ["good", "noise"]).collect()
    assert importance[0]["feature"] == "good"


def test_borders_and_bins(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("c"))
    borders = rankers.border_lists(rankers.learn_borders(df, ["x", "c"], 4))
    assert borders["c"] == [] and len(borders["x"]) == 3
    counts = rankers.apply_borders(df, borders).groupBy("bin_x").count().collect()
    assert len(counts) == 4 and max(r["count"] for r in counts) <= 27
    with pytest.raises(ValueError):
        rankers.apply_borders(df, {"c": []})


def test_epsilon_choice_prefers_order_within_tolerance():
    def result(name, mean, spread=0.0, trees=10):
        return {
            "config_id": name, "mean_precision_at_20_labeled_users": mean, "min_precision_at_20_labeled_users": 0.1,
            "fold_spread_precision_at_20_labeled_users": spread, "mean_precision_at_20_all_targets": 0.1,
            "mean_tree_count": trees,
        }

    order = ["a", "b", "c"]
    pick = comparison.choose_with_epsilon
    assert pick([result("b", 0.5), result("a", 0.5004)], 1e-3, order)["config_id"] == "a"
    assert pick([result("a", 0.5), result("b", 0.51)], 1e-3, order)["config_id"] == "b"
    assert pick([result("a", 0.5, 0.2), result("b", 0.5, 0.1)], 1e-3, order)["config_id"] == "b"
    assert pick([result("a", 0.5), result("b", 0.5, trees=9)], 1e-3, order)["config_id"] == "b"


def test_fallback_keeps_ranker_rows_first(spark):
    ranked = spark.createDataFrame([(1, 5, 9.0, 1, "r"), (1, 6, 8.0, 2, "r")],
                                   "user_id bigint, item_id int, score double, rank int, source string")
    union = spark.createDataFrame(
        [(1, 5, 7.0, 1, True), (1, 8, 6.0, 2, True), (1, 9, 0.0, 0, False), (2, 8, 6.0, 1, True)],
        "user_id bigint, item_id int, generator_score_global_popularity double,"
        " generator_rank_global_popularity int, generated_by_global_popularity boolean",
    )
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    final = popularity.rank_with_fallback(ranked, union, users, k=3)
    assert rows(final, "user_id", "rank", "item_id") == [(1, 1, 5), (1, 2, 6), (1, 3, 8), (2, 1, 8)]
    report = popularity.fallback_report(final, ranked, users, k=3).first()
    assert tuple(report) == (2, 4, 2, 2)


def found(checks):
    return {r["check"]: r["violations"] for r in checks.collect() if r["violations"]}


def test_quality_rules_find_broken_rows(spark):
    schema = "user_id bigint, item_id int, score double, rank int, source string"
    good = spark.createDataFrame([(1, 3, 2.0, 1, "s"), (1, 4, 2.0, 2, "s")], schema)
    assert found(quality.candidate_checks(good, "s", 2)) == {}
    bad = spark.createDataFrame(
        [(1, 4, 2.0, 1, "s"), (1, 3, 2.0, 2, "s"), (2, 1, float("nan"), 2, "t"), (3, 1, 1.0, 1, "s"), (3, 1, 1.0, 2, "s")],
        schema,
    )
    assert found(quality.candidate_checks(bad, "s", 2)) == {
        "other_source": 1, "score_not_finite": 1, "duplicate_user_id_item_id": 1, "ranks_not_contiguous": 1, "rank_order": 3,
    }


def test_frozen_features_reject_changes(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "user_id bigint, item_id int, x double")
    assert frozen_features(df, {"x": "double"}).columns == ["user_id", "item_id", "x"]
    for wrong in ({"x": "float"}, {"y": "double"}):
        with pytest.raises(ContractError):
            frozen_features(df, wrong)


def test_csv_round_trip_and_malformed_rows(spark, tmp_path):
    lists = spark.createDataFrame([(2**60, [3, 1, -2]), (5, [9, 8, 7])], "user_id bigint, item_ids array<int>")
    path = str(tmp_path / "lists")
    text.write_recommendations(lists, path)
    back = text.read_recommendation_text(spark, path)
    assert found(text.recommendation_text_checks(back, 3)) == {}
    assert found(quality.same_rows(text.parse_recommendations(back), lists)) == {}
    broken = [
        ("01", "[1,2,3]"), ("18446744073709551616", "[1,2,3]"), ("1", "[1,2]"), ("2", "[1,2,2]"), ("3", "[1,2,3.0]"),
        ("4", "[1,2,2147483648]"), ("5", "{}"), ("6", "[1,2,\"3\"]"), ("7", "[1,2,3]"), ("7", "[1,2,4]"),
        ("18446744073709551615", "[-1,0,1]"),
    ]
    rules = found(text.recommendation_text_checks(spark.createDataFrame(broken, "user_id string, item_ids string"), 3))
    assert rules == {
        "user_not_decimal": 1, "user_over_uint64": 1, "wrong_length": 1, "repeated_item": 1, "not_integers": 2,
        "outside_int32": 1, "not_a_json_list": 1, "duplicate_user_id": 1,
    }


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame(
        [(u, 1, "view", 2, datetime(2024, 1, 1)) for u in range(50)],
        "user_id bigint, item_id int, event_type string, watch_time bigint, date timestamp_ntz",
    )
    path = str(tmp_path / "raw")
    tables.write_sorted(raw, path, ["user_id"], partitions=4)
    scanned = tables.scan_raw(spark, path)
    users = spark.createDataFrame([(3,), (40,)], "user_id bigint")
    picked = tables.read_users(scanned, users)
    assert rows(picked, "user_id") == [(3,), (40,)]
    assert "GreaterThanOrEqual(user_id,3)" in picked._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ContractError):
        tables.scan_targets(spark, path)
    log = str(tmp_path / "log")
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int")
    tables.append_runs(log, runs.filter("run_id = 'a'"))
    tables.append_runs(log, runs)
    assert rows(spark.read.parquet(log), "run_id", "v") == [("a", 1), ("b", 2)]
    shards = tables.user_shards(raw.select("user_id"), 4).groupBy("shard").agg(
        F.min("user_id").alias("low"), F.max("user_id").alias("high")
    )
    edges = rows(shards, "low", "high")
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
