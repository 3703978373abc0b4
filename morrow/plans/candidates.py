"""Candidate tables, their union and its cross scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame

from morrow.functions.stages import write_stage
from morrow.operators.covisit import CovisitConfig, prepare_seeds, recommend_neighbors
from morrow.operators.factors import retrieve_top, score_pairs
from morrow.operators.features import attach_score_ranks
from morrow.operators.popularity import GLOBAL_SOURCE, RECENCY_SOURCE, recommend_unseen
from morrow.operators.union import (
    UnionConfig,
    attach_covisit,
    attach_factor_product,
    attach_ranking,
    build_union,
)

SOURCES = (GLOBAL_SOURCE, RECENCY_SOURCE, "item2item", "implicit_als")


@dataclass(frozen=True)
class FittedSources:
    """Everything that a fit leaves behind for prediction."""

    global_ranking: DataFrame
    recency_ranking: DataFrame
    neighbors: DataFrame
    covisit: CovisitConfig
    user_factors: DataFrame
    item_factors: DataFrame


def predict_sources(
    fitted: FittedSources,
    history: DataFrame,
    target_users: DataFrame,
    reference: datetime | Column,
    caps: Mapping[str, int],
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Candidates of the four sources at their caps, and the seeds they used.

    Seen pairs and seeds are read by several sources, so they are stored once.
    """
    seeds, seen = prepare_seeds(history, target_users, fitted.covisit.seed_k)
    seeds, seen = write_stage(seeds, "seeds"), write_stage(seen, "seen")
    tables = {
        source: predict_source(source, fitted, seeds, seen, target_users, reference, caps[source])
        for source in SOURCES
    }
    return tables, seeds


def predict_source(
    source: str,
    fitted: FittedSources,
    seeds: DataFrame | None,
    seen: DataFrame,
    target_users: DataFrame,
    reference: datetime | Column,
    cap: int,
) -> DataFrame:
    """Candidates of one source, from seeds and seen pairs of :func:`prepare_seeds`.

    Only ``item2item`` reads the seeds.
    """
    if source == GLOBAL_SOURCE:
        return recommend_unseen(fitted.global_ranking, seen, target_users, cap, source)
    if source == RECENCY_SOURCE:
        return recommend_unseen(fitted.recency_ranking, seen, target_users, cap, source)
    if source == "item2item":
        return recommend_neighbors(seeds, seen, fitted.neighbors, fitted.covisit, reference, cap)
    queries = fitted.user_factors.join(target_users.select("user_id"), "user_id", "left_semi")
    return retrieve_top(queries, fitted.item_factors, seen, cap, source)


def cross_score_union(
    union: DataFrame, fitted: FittedSources, seeds: DataFrame, reference: datetime | Column
) -> DataFrame:
    """Score every union pair under every source."""
    scored = attach_ranking(union, GLOBAL_SOURCE, fitted.global_ranking)
    scored = attach_ranking(scored, RECENCY_SOURCE, fitted.recency_ranking)
    scored = attach_covisit(scored, seeds, fitted.neighbors, fitted.covisit, reference)
    return attach_factor_product(
        scored, fitted.user_factors, fitted.item_factors
    )


def candidate_table(
    fitted: FittedSources,
    history: DataFrame,
    target_users: DataFrame,
    reference: datetime | Column,
    config: UnionConfig,
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Four sources, their union and the cross scores, stored as one stage."""
    sources, seeds = predict_sources(fitted, history, target_users, reference, config.caps)
    sources = {name: write_stage(rows, name) for name, rows in sources.items()}
    union = cross_score_union(build_union(sources, config), fitted, seeds, reference)
    return write_stage(union, "union"), seeds, sources


def expanded_union(
    scored: DataFrame, queries: DataFrame, items: DataFrame
) -> DataFrame:
    """Add embedding scores and rank all cross scores within each user's union.

    Ranks depend on the complete union and therefore precede any sampling.
    """
    with_vectors = score_pairs(scored, queries, items, "sasrec")
    return attach_score_ranks(with_vectors, ("item2item", "implicit_als", "sasrec"))


