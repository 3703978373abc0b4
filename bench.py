"""Headline queries, timed one by one; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query reads stored inputs and is executed completely into a sink that
discards the rows.  Inputs are the stages that earlier queries produce.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import (
    CAPS,
    CONFIDENCE,
    COVISIT,
    FOLD,
    FUSION,
    GLOBAL_SCORE,
    RECENCY,
    SAMPLING,
    UNION,
    PurchaseWorld,
    World,
)
from morrow.operators import covisit, factors, features, interactions, metrics, popularity
from morrow.operators import profiles, sampling, sequences, union
from morrow.plans import candidates, rows
from morrow.schemas import PAIR_KEYS
from morrow.session import local_session

QUERIES: dict[str, Callable[[World], DataFrame]] = {
    "daily_history": lambda w: interactions.aggregate_daily(w.sides[0]),
    "ground_truth": lambda w: interactions.ground_truth(w.history, w.validation, w.targets).target,
    "global_popularity_fit": lambda w: popularity.fit_global_popularity(w.history, GLOBAL_SCORE),
    "recency_popularity_fit": lambda w: popularity.fit_recency_popularity(w.history, w.cutoff, RECENCY),
    "global_popularity_predict": lambda w: popularity.recommend_unseen(
        w.global_ranking, w.seen, w.targets, CAPS["global_popularity"], "global_popularity"
    ),
    "item2item_fit": lambda w: covisit.fit_neighbors(w.history, COVISIT),
    "item2item_predict": lambda w: covisit.recommend_neighbors(
        *covisit.prepare_seeds(w.history, w.targets, COVISIT.seed_k),
        w.neighbors, COVISIT, w.cutoff, CAPS["item2item"],
    ),
    "vector_retrieval": lambda w: factors.retrieve_top(
        w.user_factors, w.item_factors, w.seen, CAPS["implicit_als"], "implicit_als"
    ),
    "candidate_union": lambda w: union.build_union(w.sources, UNION),
    "cross_scores": lambda w: candidates.cross_score_union(w.union, w.fitted, w.seeds, w.cutoff),
    "fusion_ranks": lambda w: union.fusion_candidates(w.union, FUSION),
    "user_features": lambda w: features.user_features(w.history, w.cutoff),
    "item_features": lambda w: features.item_features(w.history, w.cutoff),
    "ranker_rows": lambda w: rows.ranker_rows(
        w.scored, w.labels, w.lookups, w.seeds, w.neighbors, COVISIT, w.cutoff, FOLD, SAMPLING
    ),
    "history_profiles": lambda w: profiles.build_profiles(
        profiles.history_pairs(w.history, w.targets), w.targets, w.item_factors
    ),
    "positive_sequences": lambda w: sequences.positive_sequences(w.history),
    "negative_sampling": lambda w: sampling.sample_negatives(
        sampling.assign_labels(w.union, w.labels), FOLD, SAMPLING
    ),
    "candidate_metrics": lambda w: metrics.candidate_metrics(w.union, w.labels, w.targets),
    "als_fit": lambda w: factors.fit_als(
        factors.collapse_with_confidence(w.history, w.cutoff, CONFIDENCE), rank=8, iterations=3
    ).user_factors,
    "profile_features": lambda w: profiles.profile_features(
        w.union.select(*PAIR_KEYS), w.profiles, w.item_factors
    ),
    "precision_at_20": lambda w: metrics.precision_at_20(w.fused_lists, w.labels, w.targets),
}


def execute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def prepare(world: World) -> None:
    """Build every stored stage, which also warms the session up."""
    for name in (
        "history", "validation", "targets", "seen", "labels", "global_ranking", "recency_ranking",
        "neighbors", "predicted", "union", "scored", "lookups", "fused_lists", "profiles",
    ):
        getattr(world, name)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark: SparkSession = local_session("bench", cpus=cpus)
    timings: dict[str, float] = {}
    for label, kind in (("events", World), ("purchases", PurchaseWorld)):
        world = kind.of(spark, sf_dir)
        prepare(world)
        for name, query in QUERIES.items():
            start = time.perf_counter()
            execute(query(world))
            timings[f"{label}_{name}"] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "next_day_recommendation_queries",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
