"""Candidate union with provenance, cross scores and rank fusion."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.functions.expressions import any_of, normalized_rank, total_of, zero_sentinels
from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.ranking import bounded_rank
from morrow.functions.vectors import dot
from morrow.operators.covisit import CovisitConfig, best_contribution, seed_contributions
from morrow.operators.popularity import fill_with_popularity
from morrow.schemas import PAIR_KEYS

_SOURCE_NAME = re.compile(r"[a-z][a-z0-9_]*")


@dataclass(frozen=True)
class UnionConfig:
    """Ordered sources with their caps, and the cap of the whole union."""

    caps: Mapping[str, int]
    total_cap: int

    def __post_init__(self) -> None:
        if not self.caps:
            raise ValueError("a union needs at least one source")
        for source, cap in self.caps.items():
            if not _SOURCE_NAME.fullmatch(source):
                raise ValueError(f"bad source name {source!r}")
            if cap < 1:
                raise ValueError(f"the cap of {source} must be at least 1")
        if sum(self.caps.values()) > self.total_cap:
            raise ValueError("the source caps must fit into the total cap")


def generated(source: str) -> str:
    return f"generated_by_{source}"


def generator_score(source: str) -> str:
    return f"generator_score_{source}"


def generator_rank(source: str) -> str:
    return f"generator_rank_{source}"


def generator_rank_norm(source: str) -> str:
    return f"generator_rank_norm_{source}"


def cross_score(source: str) -> str:
    return f"cross_score_{source}"


def cross_available(source: str) -> str:
    return f"cross_score_available_{source}"


def cross_rank(source: str) -> str:
    return f"cross_rank_{source}"


def build_union(sources: Mapping[str, DataFrame], config: UnionConfig) -> DataFrame:
    """One row per (user, item) with the score and rank of every source.

    The capped sources are stacked and pivoted in a single aggregation: one shuffle
    on the pair instead of a chain of full outer joins.
    """
    if set(sources) != set(config.caps):
        raise ValueError("the candidate tables must match the configured sources")
    stacked = None
    for source, cap in config.caps.items():
        rows = sources[source].filter(F.col("rank") <= cap)
        part = rows.select(*PAIR_KEYS, "score", "rank", F.lit(source).alias("source"))
        stacked = part if stacked is None else stacked.unionByName(part)
    values = []
    for source in config.caps:
        mine = F.col("source") == source
        values.append(F.max(F.when(mine, F.col("score"))).alias(generator_score(source)))
        values.append(F.max(F.when(mine, F.col("rank"))).alias(generator_rank(source)))
    wide = stacked.groupBy(*PAIR_KEYS).agg(*values)
    columns = []
    for source, cap in config.caps.items():
        rank = F.col(generator_rank(source))
        columns += [
            F.coalesce(generator_score(source), F.lit(0.0)).alias(generator_score(source)),
            F.coalesce(rank, F.lit(0)).alias(generator_rank(source)),
            F.coalesce(normalized_rank(rank, cap), F.lit(0.0)).alias(generator_rank_norm(source)),
            rank.isNotNull().alias(generated(source)),
        ]
    count = total_of(F.col(generator_rank(s)).isNotNull().cast("smallint") for s in config.caps)
    return wide.select(*PAIR_KEYS, *columns, count.cast("smallint").alias("source_count"))


def active(source: str, cap: int) -> Column:
    """The pair was generated by the source within a cap."""
    return F.col(generated(source)) & (F.col(generator_rank(source)) <= cap)


def eligible(caps: Mapping[str, int]) -> Column:
    return any_of(active(source, cap) for source, cap in caps.items())


def attach_ranking(union: DataFrame, source: str, ranking: DataFrame) -> DataFrame:
    """Catalogue score and rank for every pair of the union."""
    lookup = ranking.select(
        "item_id",
        F.col("score").alias(cross_score(source)),
        F.col("global_rank").alias(cross_rank(source)),
    )
    joined = lookup_join(union, lookup, "item_id")
    found = F.col(cross_score(source)).isNotNull()
    return zero_sentinels(
        joined.withColumn(cross_available(source), found),
        [cross_score(source), cross_rank(source)],
    )


def attach_covisit(
    union: DataFrame,
    seeds: DataFrame,
    neighbors: DataFrame,
    config: CovisitConfig,
    reference: datetime | Column,
) -> DataFrame:
    """Best seed contribution for every pair of the union.

    Contributions are aggregated by pair and meet the union on the pair key; a
    pair outside the union finds no partner.
    """
    score = cross_score("item2item")
    best = best_contribution(seed_contributions(seeds, neighbors, config, reference), score)
    joined = pair_join(union, best, "left")
    found = F.col(score).isNotNull()
    return zero_sentinels(joined.withColumn(cross_available("item2item"), found), [score])


def attach_factor_product(
    union: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    source: str = "implicit_als"
) -> DataFrame:
    """Factor dot product for pairs whose user and item both have factors."""
    joined = lookup_join(
        union, user_factors.select("user_id", F.col("features").alias("__u")), "user_id"
    )
    joined = lookup_join(
        joined, item_factors.select("item_id", F.col("features").alias("__i")), "item_id"
    )
    known = F.col("__u").isNotNull() & F.col("__i").isNotNull()
    return (
        joined.withColumn(
            cross_score(source), F.when(known, dot("__u", "__i")).otherwise(0.0)
        )
        .withColumn(cross_available(source), known)
        .drop("__u", "__i")
    )


@dataclass(frozen=True)
class FusionConfig:
    """Reciprocal-rank fusion: caps and weights per source and the rank constant."""

    caps: Mapping[str, int]
    weights: Mapping[str, float]
    constant: float = 60.0
    final_k: int = 20

    def __post_init__(self) -> None:
        if set(self.caps) != set(self.weights):
            raise ValueError("caps and weights must cover the same sources")
        if self.constant <= 0 or any(w <= 0 for w in self.weights.values()):
            raise ValueError("weights and the rank constant must be positive")


def fusion_scores(union: DataFrame, config: FusionConfig) -> DataFrame:
    """Sum of weight / (constant + rank) over the sources that supplied the pair."""
    parts = [
        F.when(
            active(source, cap),
            F.lit(float(config.weights[source]))
            / (F.lit(float(config.constant)) + F.col(generator_rank(source)).cast("double")),
        ).otherwise(0.0)
        for source, cap in config.caps.items()
    ]
    return union.filter(eligible(config.caps)).select(
        *PAIR_KEYS, total_of(parts).alias("ranker_score")
    )


def fusion_candidates(union: DataFrame, config: FusionConfig) -> DataFrame:
    """Fused scores as a ranked candidate table."""
    scored = fusion_scores(union, config).withColumnRenamed("ranker_score", "score")
    order = [F.desc("score"), F.asc("item_id")]
    # A user has at most the sum of the caps of eligible pairs.
    return bounded_rank(scored, "user_id", order, "rank").select(
        *PAIR_KEYS, "score", "rank", F.lit("rrf_ensemble").alias("source")
    )


def fusion_recommend(
    union: DataFrame,
    config: FusionConfig,
    popular: DataFrame,
    target_users: DataFrame,
    history: DataFrame,
) -> DataFrame:
    """Fused top list with popularity in the free slots."""
    ranked = fusion_candidates(union, config)
    return fill_with_popularity(ranked, popular, target_users, history, config.final_k)


def source_contribution(
    union: DataFrame, truth: DataFrame, caps: Mapping[str, int]
) -> DataFrame:
    """Relevant pairs per source, exclusive to a source and shared by two sources."""
    hits = union.join(truth.select(*PAIR_KEYS), PAIR_KEYS, "left_semi")
    flags = {source: active(source, cap) for source, cap in caps.items()}
    count = total_of(flag.cast("int") for flag in flags.values())
    sources = list(caps)
    aggregates = [F.count_if(count > 0).alias("union_hits")]
    for source in sources:
        aggregates.append(F.count_if(flags[source]).alias(f"source__{source}"))
        aggregates.append(
            F.count_if(flags[source] & (count == 1)).alias(f"exclusive__{source}")
        )
    for i, left in enumerate(sources):
        for right in sources[i + 1 :]:
            aggregates.append(
                F.count_if(flags[left] & flags[right]).alias(f"overlap__{left}__{right}")
            )
    return hits.agg(*aggregates)


def availability(union: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Share of union pairs with a cross score, per source."""
    return union.agg(
        *[F.avg(F.col(cross_available(s)).cast("double")).alias(f"available_{s}") for s in sources]
    )


def union_summary(union: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Rows and users of a union, candidates per user and rows per source."""
    per_user = union.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(generated(s))).alias(s) for s in sources],
    )
    return per_user.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("users"),
        F.min("rows").alias("min_candidates"),
        F.max("rows").alias("max_candidates"),
        *[F.sum(s).alias(f"contribution_{s}") for s in sources],
        *[F.count_if(F.col(s) > 0).alias(f"users_{s}") for s in sources],
    )
