"""Data-quality checks.

Every check returns a table ``(check, violations)`` with one row per rule, so a
job can store it, fail on it or alert on it; nothing is raised lazily.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morrow.functions.expressions import any_of, finite, instant, normalized_rank, total_of
from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.ranking import global_rank
from morrow.operators.interactions import known_items, seen_pairs
from morrow.operators.popularity import list_pairs
from morrow.operators.union import (
    cross_available,
    cross_score,
    generated,
    generator_rank,
    generator_rank_norm,
    generator_score,
)
from morrow.schemas import PAIR_KEYS, differences


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Count the rows that break each rule in a single aggregation."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(n) for n, bad in rules.items()])
    rows = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in rules]
    )
    return counts.select(F.explode(rows).alias("row")).select("row.check", "row.violations")


def count_as_violation(df: DataFrame, check: str) -> DataFrame:
    """All rows of the frame are violations of one rule."""
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(check).alias("check"), "violations"
    )


def all_checks(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def no_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    return violation_counts(df, {f"null_{n}": F.col(n).isNull() for n in names})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return count_as_violation(duplicate_keys(df, keys), "duplicate_" + "_".join(keys))


def schema_check(df: DataFrame, expected: dict[str, T.DataType]) -> DataFrame:
    """One row per schema difference, from metadata only."""
    found = differences(df, expected)
    schema = "check string, violations bigint"
    return df.sparkSession.createDataFrame([(text, 1) for text in found], schema)


def _group_rank_checks(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str, limit: int
) -> DataFrame:
    """Ranks 1..n per group in the given order, at most ``limit`` of them.

    The expected rank is a window over groups that the contract bounds by ``limit``.
    """
    expected = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    misplaced = df.withColumn("__expected", expected).filter(F.col("__expected") != F.col(rank))
    groups = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(rank).alias("lowest"),
        F.max(rank).alias("highest"),
    )
    sizes = violation_counts(
        groups,
        {
            "ranks_not_contiguous": (F.col("lowest") != 1) | (F.col("highest") != F.col("rows")),
            "more_than_k_rows": F.col("rows") > limit,
        },
    )
    return all_checks(sizes, count_as_violation(misplaced, "rank_order"))


def candidate_checks(candidates: DataFrame, source: str, k: int) -> DataFrame:
    rules = {
        "null_cell": any_of(F.col(n).isNull() for n in candidates.columns),
        "other_source": F.col("source") != source,
        "score_not_finite": ~finite("score"),
    }
    order = [F.desc("score"), F.asc("item_id")]
    return all_checks(
        violation_counts(candidates, rules),
        unique_keys(candidates, PAIR_KEYS),
        _group_rank_checks(candidates, ["user_id"], order, "rank", k),
    )


def neighbor_checks(neighbors: DataFrame, neighbor_k: int, min_pair_users: int = 1) -> DataFrame:
    rules = {
        "null_cell": any_of(F.col(n).isNull() for n in neighbors.columns),
        "self_link": F.col("item_id") == F.col("neighbor_item_id"),
        "score_not_positive": ~(finite("score") & (F.col("score") > 0)),
        "too_few_users": F.col("co_user_count") < min_pair_users,
    }
    order = [F.desc("score"), F.asc("neighbor_item_id")]
    return all_checks(
        violation_counts(neighbors, rules),
        unique_keys(neighbors, ["item_id", "neighbor_item_id"]),
        _group_rank_checks(neighbors, ["item_id"], order, "rank", neighbor_k),
    )


def ranking_checks(ranking: DataFrame, *, positive_scores: bool = False) -> DataFrame:
    """Item ranking: unique items and ranks that follow score and item id."""
    order = [F.desc("score"), F.asc("item_id")]
    expected = global_rank(ranking.select("item_id", "score", "global_rank"), order, "expected")
    rules = {
        "null_cell": any_of(F.col(n).isNull() for n in ("item_id", "score", "global_rank")),
        "score_not_finite": ~finite("score"),
        "rank_order": F.col("expected") != F.col("global_rank"),
    }
    if positive_scores:
        rules["score_not_positive"] = F.col("score") <= 0
    return all_checks(violation_counts(expected, rules), unique_keys(ranking, ["item_id"]))


def union_checks(
    union: DataFrame, caps: Mapping[str, int], total_cap: int, cross: Sequence[str] = ()
) -> DataFrame:
    rules: dict[str, Column] = {"null_cell": any_of(F.col(n).isNull() for n in union.columns)}
    for source, cap in caps.items():
        there = F.col(generated(source))
        score, rank, norm = (
            F.col(generator_score(source)),
            F.col(generator_rank(source)),
            F.col(generator_rank_norm(source)),
        )
        rules[f"sentinel_{source}"] = ~there & ((score != 0) | (rank != 0) | (norm != 0))
        rules[f"rank_{source}"] = there & ~(
            rank.between(1, cap) & (F.abs(norm - normalized_rank(rank, cap)) <= 1e-12)
        )
        rules[f"finite_{source}"] = ~finite(score)
    flags = total_of(F.col(generated(source)).cast("int") for source in caps)
    rules["source_count"] = (F.col("source_count") != flags) | (F.col("source_count") == 0)
    for source in cross:
        score = F.col(cross_score(source))
        rules[f"cross_{source}"] = ~finite(score) | (~F.col(cross_available(source)) & (score != 0))
    sizes = union.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    return all_checks(
        violation_counts(union, rules),
        unique_keys(union, PAIR_KEYS),
        count_as_violation(sizes.filter(F.col("rows") > total_cap), "total_cap"),
    )


def missing_item_lookups(features: DataFrame) -> DataFrame:
    """Candidate pairs whose item had no history features."""
    return count_as_violation(
        features.filter(F.col("item_history_available").isNull()), "missing_item_features"
    )


def history_cutoff(daily: DataFrame, cutoff: datetime | Column) -> DataFrame:
    """Rows, range and timestamps at or after the cutoff."""
    return daily.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("dt").alias("min_dt"),
        F.max("dt").alias("max_dt"),
        F.count_if(F.col("dt").isNull()).alias("null_timestamps"),
        F.count_if(F.col("dt") >= instant(cutoff)).alias("timestamps_at_or_after_cutoff"),
    )


def known_and_unseen(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Pairs with an item unknown to history, and pairs the user has already seen."""
    unknown = lookup_join(pairs.select(*PAIR_KEYS), known_items(history), "item_id", "left_anti")
    seen = pair_join(pairs.select(*PAIR_KEYS), seen_pairs(history), "left_semi")
    return all_checks(
        count_as_violation(unknown, "unknown_item"), count_as_violation(seen, "seen_pair")
    )


def recommendation_checks(
    recommendations: DataFrame, target_users: DataFrame, history: DataFrame, k: int = 20
) -> DataFrame:
    items = F.col("item_ids")
    rules = {
        "null_cell": F.col("user_id").isNull() | items.isNull(),
        "list_size": F.size(items) != k,
        "repeated_item": F.size(F.array_distinct(items)) != F.size(items),
        "null_item": F.size(F.array_compact(items)) != F.size(items),
    }
    users, targets = recommendations.select("user_id"), target_users.select("user_id")
    return all_checks(
        violation_counts(recommendations, rules),
        unique_keys(recommendations, ["user_id"]),
        count_as_violation(targets.join(users, "user_id", "left_anti"), "missing_user"),
        count_as_violation(users.join(targets, "user_id", "left_anti"), "extra_user"),
        known_and_unseen(list_pairs(recommendations), history),
    )


def feature_table_checks(features: DataFrame) -> DataFrame:
    """Ranker output or feature table: complete, unique pairs, finite numbers."""
    floats = [
        f.name for f in features.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    rules = {"null_cell": any_of(F.col(n).isNull() for n in features.columns)}
    if floats:
        rules["not_finite"] = any_of(~finite(n) for n in floats)
    return all_checks(violation_counts(features, rules), unique_keys(features, PAIR_KEYS))


def ranker_dataset_checks(rows: DataFrame) -> DataFrame:
    kept, p = F.col("is_training_sample"), F.col("sampling_probability")
    rules = {
        "label_not_binary": ~F.col("label").isin(0, 1),
        "positive_dropped": (F.col("label") == 1) & ~kept,
        "hard_negative_dropped": F.col("is_hard_negative") & ~kept,
        "probability_range": ~((p > 0) & (p <= 1)),
    }
    return all_checks(violation_counts(rows, rules), feature_table_checks(rows))


def covisit_parity(features: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Co-visitation features must agree with the cross score of the union."""
    there, cross = F.col("covisit_available"), F.col(cross_available("item2item"))
    gap = F.abs(F.col("covisit_contribution_max") - F.col(cross_score("item2item")))
    return violation_counts(
        features, {"covisit_availability": there != cross, "covisit_score": there & (gap > tolerance)}
    )


def factor_parity(features: DataFrame) -> DataFrame:
    return violation_counts(
        features,
        {"factor_availability": F.col("als_mapping_available") != F.col(cross_available("implicit_als"))},
    )


def scope_checks(folds: DataFrame, horizon: datetime | Column) -> DataFrame:
    """Fold table (fold, cutoff): label days must end by the evaluation horizon."""
    end = F.col("cutoff") + F.expr("INTERVAL 1 DAY")
    return all_checks(
        violation_counts(folds, {"label_day_after_horizon": end > instant(horizon)}),
        unique_keys(folds, ["cutoff"]),
    )


def grouped_source_checks(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    rules = {
        "null_cell": any_of(F.col(n).isNull() for n in (*PAIR_KEYS, "label", *features)),
        "label_not_binary": ~F.col("label").isin(0, 1),
        "feature_not_finite": any_of(~finite(F.col(n).cast("float")) for n in features),
    }
    return all_checks(violation_counts(rows, rules), unique_keys(rows, PAIR_KEYS))


def universe_checks(users_of: Mapping[str, DataFrame], target_users: DataFrame) -> DataFrame:
    """Users of each table that are outside the target universe."""
    parts = [
        count_as_violation(
            lookup_join(rows.select("user_id").distinct(), target_users.select("user_id"), "user_id", "left_anti"),
            f"users_outside_targets_{name}",
        )
        for name, rows in users_of.items()
    ]
    return all_checks(*parts)


def daily_checks(daily: DataFrame, confidence_rows: DataFrame | None = None) -> DataFrame:
    """Unique daily keys, positive views, binary flags and positive confidence."""
    rules = {
        "views_not_positive": F.col("views") <= 0,
        "like_not_binary": ~F.col("is_like").isin(0, 1),
        "favorite_not_binary": ~F.col("is_favorite").isin(0, 1),
    }
    parts = [violation_counts(daily, rules), unique_keys(daily, ["user_id", "item_id", "date"])]
    if confidence_rows is not None:
        bad = ~(finite("confidence") & (F.col("confidence") > 0))
        parts.append(violation_counts(confidence_rows, {"confidence_not_positive": bad}))
    return all_checks(*parts)


def prefix_checks(deeper: DataFrame, frozen: DataFrame, k: int) -> DataFrame:
    """The first ``k`` ranks of a deeper list must equal the frozen list."""
    columns = [*PAIR_KEYS, "rank"]
    left = deeper.filter(F.col("rank") <= k).select(*columns)
    right = frozen.select(*columns)
    return all_checks(
        count_as_violation(left.exceptAll(right), "not_in_frozen"),
        count_as_violation(right.exceptAll(left), "missing_from_deeper"),
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, counted with repeats, that only one of two tables has."""
    return all_checks(
        count_as_violation(left.exceptAll(right), "only_left"),
        count_as_violation(right.exceptAll(left), "only_right"),
    )


def table_checksum(df: DataFrame) -> DataFrame:
    """Order-independent content hash: xor and sum of 60 bits of each row's MD5.

    Columns enter as text in their order, null as a text that no number or date has.
    """
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("\x00")) for name in df.columns]
    digits = F.left(F.md5(F.concat_ws("\x1f", *cells)), F.lit(15))
    hashed = df.select(F.conv(digits, 16, 10).cast("bigint").alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("h").alias("xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("total"),
    )
