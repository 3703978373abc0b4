"""Feature and training tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.operators.covisit import CovisitConfig, seed_contributions
from morrow.operators.features import (
    attach_covisit_features,
    attach_factor_features,
    attach_history_features,
    attach_score_ranks,
)
from morrow.operators.profiles import profile_features
from morrow.operators.sampling import (
    NegativeSampling,
    assign_labels,
    feature_columns,
    sample_negatives,
)
from morrow.schemas import PAIR_KEYS, ContractError


def inference_rows(
    union: DataFrame,
    lookups: Mapping[str, DataFrame],
    seeds: DataFrame,
    neighbors: DataFrame,
    config: CovisitConfig,
    cutoff: datetime | Column,
    rank_sources: Sequence[str] = ("item2item", "implicit_als"),
) -> DataFrame:
    """All inference-time features of the union's pairs, no labels involved.

    The steps that shuffle (ranks per user, evidence per pair) run on the narrow
    union; the wide history lookups come last and only widen rows in place.
    """
    rows = attach_covisit_features(union, seed_contributions(seeds, neighbors, config, cutoff))
    rows = attach_score_ranks(rows, rank_sources)
    rows = attach_factor_features(rows, lookups["als_user_norms"], lookups["als_item_norms"])
    return attach_history_features(rows, lookups["user_features"], lookups["item_features"])


def ranker_rows(
    union: DataFrame,
    truth: DataFrame,
    lookups: Mapping[str, DataFrame],
    seeds: DataFrame,
    neighbors: DataFrame,
    config: CovisitConfig,
    cutoff: datetime | Column,
    fold: str,
    sampling: NegativeSampling,
) -> DataFrame:
    """Labeled, sampled rows with all features of every candidate.

    Labels and the sampling mask need only union columns, so they too are attached
    while the rows are narrow; no feature depends on them.
    """
    labeled = sample_negatives(assign_labels(union, truth), fold, sampling)
    return inference_rows(labeled, lookups, seeds, neighbors, config, cutoff)


def frozen_features(rows: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Features in a frozen order; names and types must match what was frozen."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    wrong = [
        f"{name}: {types.get(name)} is not {kind}"
        for name, kind in expected.items()
        if types.get(name) != kind
    ]
    extra = sorted(set(feature_columns(rows)) - set(expected))
    if wrong or extra:
        raise ContractError(f"features differ from the frozen list: {wrong}, extra {extra}")
    return rows.select(*PAIR_KEYS, *expected)


def materialize_features(
    sampled: DataFrame,
    lookups: Mapping[str, DataFrame],
    seeds: DataFrame,
    neighbors: DataFrame,
    config: CovisitConfig,
    cutoff: datetime | Column,
    profiles: DataFrame,
    item_factors: DataFrame,
    *,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Pair features only for rows that survived sampling; ranks stay as they are."""
    rows = attach_history_features(sampled, lookups["user_features"], lookups["item_features"])
    rows = attach_covisit_features(rows, seed_contributions(seeds, neighbors, config, cutoff))
    rows = attach_factor_features(rows, lookups["als_user_norms"], lookups["als_item_norms"])
    rows = profile_features(rows, profiles, item_factors)
    names = list(features or [c for c in feature_columns(rows) if c != "als_mapping_available"])
    kept = [c for c in ("label", "sample_weight") if c in rows.columns]
    return rows.select(*PAIR_KEYS, *kept, *[F.col(n).cast("float").alias(n) for n in names])
