"""Implicit factor models and retrieval over vector tables."""

from __future__ import annotations

import math

from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morrow.functions.expressions import age_hours, half_life_decay, long_watch
from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.ranking import global_rank, top_rows
from morrow.functions.vectors import ZERO_NORM, clip_cosine, dot, norm
from morrow.schemas import PAIR_KEYS


@dataclass(frozen=True)
class ConfidenceConfig:
    """Weights of the implicit confidence and the decay of old evidence."""

    interaction_weight: float = 1.0
    view_weight: float = 1.0
    long_watch_weight: float = 1.0
    like_weight: float = 1.0
    favorite_weight: float = 1.0
    half_life_hours: float | None = None


def confidence(config: ConfidenceConfig, reference: datetime | Column) -> Column:
    repeats = F.log1p(F.greatest(F.col("views").cast("double") - 1.0, F.lit(0.0)))
    signal = (
        F.lit(float(config.interaction_weight))
        + F.lit(float(config.view_weight)) * repeats
        + F.lit(float(config.long_watch_weight)) * long_watch().cast("double")
        + F.lit(float(config.like_weight)) * F.col("is_like").cast("double")
        + F.lit(float(config.favorite_weight)) * F.col("is_favorite").cast("double")
    )
    decay = half_life_decay(age_hours("last_dt", reference), config.half_life_hours)
    return (F.lit(1.0) + signal * decay).cast("float")


def collapse_with_confidence(
    daily: DataFrame, reference: datetime | Column, config: ConfidenceConfig
) -> DataFrame:
    """One row per pair with its implicit confidence."""
    pairs = daily.groupBy(*PAIR_KEYS).agg(
        F.sum("views").alias("views"),
        F.max("watch_time").alias("watch_time"),
        F.max("is_like").alias("is_like"),
        F.max("is_favorite").alias("is_favorite"),
        F.max("dt").alias("last_dt"),
    )
    return pairs.withColumn("confidence", confidence(config, reference))


def index_ids(rows: DataFrame, key: str, index: str, *, start: int = 0) -> DataFrame:
    """Contiguous index of the distinct sorted ids."""
    ids = rows.select(key).distinct()
    ranked = global_rank(ids, [F.asc(key)], "__rank")
    return ranked.select(key, (F.col("__rank") - 1 + start).cast("int").alias(index))


@dataclass(frozen=True)
class FactorModel:
    """Factor tables keyed by the source ids, with the fitted Spark model."""

    user_factors: DataFrame
    item_factors: DataFrame
    model: ALSModel


def fit_als(
    pairs: DataFrame,
    *,
    rank: int = 64,
    iterations: int = 15,
    regularization: float = 0.01,
    seed: int = 42,
) -> FactorModel:
    """Weighted implicit factorization on confidences.

    Spark uses ``1 + alpha * rating`` as confidence, so the rating is confidence
    minus one, floored so that every observed pair counts as a preference.
    """
    users, items = index_ids(pairs, "user_id", "user"), index_ids(pairs, "item_id", "item")
    rows = lookup_join(lookup_join(pairs, users, "user_id", "inner"), items, "item_id", "inner")
    ratings = rows.select(
        "user", "item", F.greatest(F.col("confidence") - 1.0, F.lit(1e-6)).cast("float").alias("rating")
    )
    model = ALS(
        userCol="user",
        itemCol="item",
        ratingCol="rating",
        implicitPrefs=True,
        alpha=1.0,
        rank=rank,
        maxIter=iterations,
        regParam=regularization,
        seed=seed,
        coldStartStrategy="drop",
    ).fit(ratings)

    def keyed(factors: DataFrame, ids: DataFrame, index: str, key: str) -> DataFrame:
        return factors.withColumnRenamed("id", index).join(ids, index).select(key, "features")

    return FactorModel(
        user_factors=keyed(model.userFactors, users, "user", "user_id"),
        item_factors=keyed(model.itemFactors, items, "item", "item_id"),
        model=model,
    )


def _block_top(k: int, slice_rows: int = 256):
    """Score one block of queries against one block of items, a few queries at a time.

    A query gets exactly ``k + seen_here`` rows of the block (or all): ties go to smaller ids.
    """

    def score(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or items.empty:
            return pd.DataFrame({"user_id": [], "item_id": [], "score": []})
        items = items.sort_values("item_id", kind="stable")
        left = np.stack(queries["features"].to_numpy()).astype(np.float64)
        right = np.stack(items["features"].to_numpy()).astype(np.float64).T
        users, ids = queries["user_id"].to_numpy(), items["item_id"].to_numpy()
        keep = np.minimum(k + queries["seen_here"].to_numpy(), len(ids)).astype(int)
        found = []
        for start in range(0, len(users), slice_rows):
            scores = left[start : start + slice_rows] @ right
            for row, count in zip(range(len(scores)), keep[start:]):
                edge = np.partition(scores[row], len(ids) - count)[len(ids) - count]
                above = np.flatnonzero(scores[row] > edge)
                ties = np.flatnonzero(scores[row] == edge)[: count - len(above)]  # smallest ids
                best = np.concatenate([above, ties])
                found.append((np.full(len(best), start + row), best, scores[row][best]))
        rows, columns, values = (np.concatenate(part) for part in zip(*found))
        return pd.DataFrame({"user_id": users[rows], "item_id": ids[columns], "score": values})

    return score


def retrieve_top(
    queries: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    k: int,
    source: str,
    *,
    block_rows: int = 16384,
) -> DataFrame:
    """Exact unseen top ``k`` items per query vector.

    Queries and items are hashed into blocks of about ``block_rows`` vectors and
    every task multiplies one block of each, so no task holds more than two blocks
    and no side is broadcast.  Every query meets every item block, so the shuffled
    copies shrink as blocks grow.  A block returns the best ``k`` plus as many rows as
    the user has seen in it, which is enough after the seen pairs are removed.
    """
    query_blocks = max(1, math.ceil(queries.count() / block_rows))
    item_blocks = max(1, math.ceil(items.count() / block_rows))
    placed = items.select(
        "item_id",
        "features",
        F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).cast("int").alias("item_block"),
    )
    pairs = lookup_join(seen.select(*PAIR_KEYS), queries.select("user_id"), "user_id", "left_semi")
    seen_here = (
        lookup_join(pairs, placed.select("item_id", "item_block"), "item_id", "inner")
        .groupBy("user_id", "item_block")
        .agg(F.count(F.lit(1)).alias("seen_here"))
    )
    left = (
        queries.select(
            "user_id",
            "features",
            F.pmod(F.xxhash64("user_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
            F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("item_block"),
        )
        .join(seen_here, ["user_id", "item_block"], "left")
        .withColumn("seen_here", F.coalesce("seen_here", F.lit(0)))
    )
    right = placed.withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    schema = T.StructType(
        [queries.schema["user_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())]
    )
    tops = (
        left.groupBy("query_block", "item_block")
        .cogroup(right.groupBy("query_block", "item_block"))
        .applyInPandas(_block_top(k), schema)
    )
    unseen = pair_join(tops, seen.select(*PAIR_KEYS), "left_anti")
    order = [F.desc("score"), F.asc("item_id")]
    return top_rows(unseen, "user_id", order, k).select(
        *PAIR_KEYS, "score", "rank", F.lit(source).alias("source")
    )


def score_pairs(
    pairs: DataFrame, queries: DataFrame, items: DataFrame, source: str
) -> DataFrame:
    """Score, norms and cosine of arbitrary pairs, zero where a vector is missing."""
    joined = lookup_join(
        pairs, queries.select("user_id", F.col("features").alias("__q")), "user_id"
    )
    joined = lookup_join(joined, items.select("item_id", F.col("features").alias("__v")), "item_id")
    there = F.col("__q").isNotNull() & F.col("__v").isNotNull()

    def known(value: Column) -> Column:
        return F.when(there, value).otherwise(0.0)

    measured = joined.select(
        *pairs.columns,
        known(dot("__q", "__v")).alias(f"cross_score_{source}"),
        there.alias(f"cross_score_available_{source}"),
        known(norm("__q")).alias(f"{source}_query_norm"),
        known(norm("__v")).alias(f"{source}_item_norm"),
    )
    scale = F.greatest(
        F.col(f"{source}_query_norm") * F.col(f"{source}_item_norm"), F.lit(ZERO_NORM)
    )
    return measured.withColumn(
        f"{source}_cosine", clip_cosine(F.col(f"cross_score_{source}") / scale)
    )
