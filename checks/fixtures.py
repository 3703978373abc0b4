"""The test tables read as interaction logs, and the stages built from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morrow.functions.stages import shared_folder, write_stage
from morrow.operators import covisit, factors, features, interactions, popularity, profiles
from morrow.operators import rankers, sampling, sequences, union
from morrow.plans import candidates, rows

DIM = 64
FOLD = "canonical"
SEED = 42
K = 20
CAPS = {"global_popularity": 20, "recency_popularity": 20, "item2item": 20, "implicit_als": 20}
TOTAL_CAP = 80
UNION = union.UnionConfig(CAPS, TOTAL_CAP)
GLOBAL_SCORE = "distinct_relevant_users"
RECENCY = popularity.DecayedViews(24.0)
COVISIT = covisit.CovisitConfig(
    normalization="cosine",
    history_cap=10,
    neighbor_k=20,
    seed_k=5,
    seed_half_life_hours=24.0,
    seed_strength="event",
)
FUSION = union.FusionConfig(
    {"global_popularity": 10, "recency_popularity": 15, "item2item": 20, "implicit_als": 20},
    {"global_popularity": 0.5, "recency_popularity": 1.0, "item2item": 1.5, "implicit_als": 2.0},
    constant=10.0,
)
SAMPLING = sampling.NegativeSampling(easy_probability=0.05, hard_rank=5)
CONFIDENCE = factors.ConfidenceConfig(1.0, 0.5, 1.0, 2.0, 3.0, half_life_hours=72.0)
MODEL_FEATURES = [
    "source_count",
    "cross_score_global_popularity",
    "cross_score_recency_popularity",
    "cross_score_item2item",
    "cross_score_implicit_als",
    "union_rank_norm_cross_score_item2item",
    "union_rank_norm_cross_score_implicit_als",
    "user_daily_rows_all",
    "user_positive_daily_rate_all",
    "item_daily_rows_24h",
    "item_positive_daily_rate_all",
    "covisit_contribution_sum",
    "covisit_matched_seed_count",
    "als_cosine_similarity",
]


def events_log(tables: Callable[[str], DataFrame]) -> DataFrame:
    """Click becomes like, purchase becomes favorite; the item is the JSON key."""
    kind = (
        F.when(F.col("event_type") == "click", "like")
        .when(F.col("event_type") == "purchase", "favorite")
        .otherwise("view")
    )
    return tables("events").select(
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        kind.alias("event_type"),
        F.floor("value").cast("bigint").alias("watch_time"),
        F.col("ts").alias("date"),
    )


def purchases_log(tables: Callable[[str], DataFrame]) -> DataFrame:
    """Customer by part: the larger log, with items that appear late."""
    kind = (
        F.when(F.col("l_returnflag") == "R", "like")
        .when(F.col("l_returnflag") == "A", "favorite")
        .otherwise("view")
    )
    lines = tables("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    orders = tables("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        kind.alias("event_type"),
        (F.col("l_quantity") * 2).cast("bigint").alias("watch_time"),
        F.col("o_orderdate").alias("date"),
    )


class World:
    """Stages of one log, built on first use and shared by the queries of a session."""

    _known: dict[tuple[str, str], World] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> World:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    # ---- log, split, truth -------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        return events_log(self.table)

    @cached_property
    def cutoff(self) -> datetime:
        return interactions.infer_cutoff(self.raw).first()["cutoff"]

    @cached_property
    def sides(self) -> tuple[DataFrame, DataFrame]:
        return interactions.split_interactions(self.raw, self.cutoff)

    @cached_property
    def history(self) -> DataFrame:
        return write_stage(interactions.aggregate_daily(self.sides[0]), "history")

    @cached_property
    def validation(self) -> DataFrame:
        return write_stage(interactions.aggregate_daily(self.sides[1]), "validation")

    @cached_property
    def targets(self) -> DataFrame:
        return write_stage(self.raw.select("user_id").distinct(), "targets")

    @cached_property
    def truth(self) -> interactions.GroundTruth:
        return interactions.ground_truth(self.history, self.validation, self.targets)

    @cached_property
    def labels(self) -> DataFrame:
        return write_stage(self.truth.target, "truth")

    @cached_property
    def early(self) -> EarlyFold:
        return EarlyFold(self)

    # ---- sources -----------------------------------------------------------
    @cached_property
    def global_ranking(self) -> DataFrame:
        return write_stage(
            popularity.fit_global_popularity(self.history, GLOBAL_SCORE), "global_ranking"
        )

    @cached_property
    def recency_ranking(self) -> DataFrame:
        return write_stage(
            popularity.fit_recency_popularity(self.history, self.cutoff, RECENCY), "recency_ranking"
        )

    @cached_property
    def collapsed(self) -> DataFrame:
        return covisit.collapse_history(self.history)

    @cached_property
    def neighbors(self) -> DataFrame:
        return write_stage(covisit.fit_neighbors(self.history, COVISIT), "neighbors")

    @cached_property
    def item_factors(self) -> DataFrame:
        """The vectors whose number is an item of the log."""
        vectors = self.table("embeddings").select(
            F.col("vec_id").cast("int").alias("item_id"), F.col("embedding").alias("features")
        )
        known = vectors.join(self.raw.select("item_id").distinct(), "item_id", "left_semi")
        return write_stage(known, "item_factors")

    @cached_property
    def user_factors(self) -> DataFrame:
        """The vectors whose number minus 200 is a user of the log."""
        vectors = self.table("embeddings").select(
            (F.col("vec_id") - 200).alias("user_id"), F.col("embedding").alias("features")
        )
        return write_stage(vectors.join(self.targets, "user_id", "left_semi"), "user_factors")

    #: The world itself has what a fit leaves behind; each part is fitted on first use.
    covisit = COVISIT

    @property
    def fitted(self) -> World:
        return self

    @cached_property
    def sources(self) -> Sources:
        return Sources(self)

    @cached_property
    def seeds(self) -> DataFrame:
        seeds, _ = covisit.prepare_seeds(self.history, self.targets, COVISIT.seed_k)
        return write_stage(seeds, "seeds")

    @cached_property
    def seen(self) -> DataFrame:
        """All pairs of the history: every user of the log is a target."""
        return write_stage(interactions.seen_pairs(self.history), "seen")

    # ---- union, features, rows ----------------------------------------------
    @cached_property
    def union(self) -> DataFrame:
        return write_stage(union.build_union(self.sources, UNION), "union")

    @cached_property
    def scored(self) -> DataFrame:
        return write_stage(
            candidates.cross_score_union(self.union, self.fitted, self.seeds, self.cutoff), "scored"
        )

    @cached_property
    def contributions(self) -> DataFrame:
        return covisit.seed_contributions(self.seeds, self.neighbors, COVISIT, self.cutoff)

    @cached_property
    def lookups(self) -> Lookups:
        return Lookups(self)

    @cached_property
    def inference_rows(self) -> DataFrame:
        table = rows.inference_rows(
            self.scored, self.lookups, self.seeds, self.neighbors, COVISIT, self.cutoff
        )
        return write_stage(table, "inference_rows")

    @cached_property
    def dataset(self) -> DataFrame:
        table = rows.ranker_rows(
            self.scored, self.labels, self.lookups, self.seeds, self.neighbors, COVISIT,
            self.cutoff, FOLD, SAMPLING,
        )
        return write_stage(table, "dataset")

    @cached_property
    def labeled_union(self) -> DataFrame:
        labeled = sampling.assign_labels(self.union, self.labels)
        return write_stage(sampling.sample_negatives(labeled, FOLD, SAMPLING), "labeled_union")

    @cached_property
    def profiles(self) -> DataFrame:
        pairs = profiles.history_pairs(self.history, self.targets)
        return write_stage(
            profiles.build_profiles(pairs, self.targets, self.item_factors), "profiles"
        )

    @cached_property
    def sequences(self) -> DataFrame:
        return write_stage(sequences.positive_sequences(self.history), "sequences")

    # ---- lists and rankers ---------------------------------------------------
    @cached_property
    def fused(self) -> DataFrame:
        return write_stage(union.fusion_candidates(self.union, FUSION), "fused")

    @cached_property
    def fused_lists(self) -> DataFrame:
        final = union.fusion_recommend(
            self.union, FUSION, self.sources["global_popularity"], self.targets, self.history
        )
        return write_stage(popularity.ordered_lists(final, "final_rank"), "fused_lists")

    @cached_property
    def popular_lists(self) -> DataFrame:
        return write_stage(
            popularity.candidates_to_lists(self.sources["global_popularity"], K), "popular_lists"
        )

    @cached_property
    def train(self) -> DataFrame:
        sampled = sampling.second_stage(
            self.dataset, fold=FOLD, seed=SEED, negative_probability=1.0, features=MODEL_FEATURES
        )
        return write_stage(sampled, "train")

    @cached_property
    def tree_model(self):
        return rankers.fit_trees(
            self.train, MODEL_FEATURES, rankers.TreeConfig(trees=8, depth=3, step=0.2)
        )

    @cached_property
    def groups(self) -> DataFrame:
        return write_stage(sampling.group_ids(self.targets), "groups")

    @cached_property
    def group_model(self) -> rankers.GroupRanker:
        grouped = sampling.grouped_rows(
            self.dataset, self.groups, MODEL_FEATURES, training_only=False
        )
        return rankers.fit_group_ranker(grouped, MODEL_FEATURES, iterations=5)

    @cached_property
    def scores(self) -> DataFrame:
        """A transparent ranker score: two cross scores of the union."""
        return write_stage(
            self.scored.select(
                "user_id",
                "item_id",
                F.round(
                    F.col("cross_score_item2item") + 0.1 * F.col("cross_score_implicit_als"), 9
                ).alias("ranker_score"),
            ),
            "scores",
        )


class Sources(Mapping):
    """Candidate tables of a world by source; each is predicted and stored on first use.

    A query of one source, or of the seeds alone, does not pay for the others.
    """

    def __init__(self, world: World) -> None:
        self.world = world
        self.stored: dict[str, DataFrame] = {}

    def __getitem__(self, source: str) -> DataFrame:
        if source not in self.stored:
            w = self.world
            table = candidates.predict_source(
                source, w.fitted, w.seeds if source == "item2item" else None,
                w.seen, w.targets, w.cutoff, CAPS[source],
            )
            self.stored[source] = write_stage(table, source)
        return self.stored[source]

    def __iter__(self) -> Iterator[str]:
        return iter(CAPS)

    def __len__(self) -> int:
        return len(CAPS)


class Lookups(Mapping):
    """Feature tables of a world by name; each is built and stored on first use."""

    BUILD = {
        "user_features": lambda w: features.user_features(w.history, w.cutoff),
        "item_features": lambda w: features.item_features(w.history, w.cutoff),
        "als_user_norms": lambda w: features.factor_norms(w.user_factors, "user_id"),
        "als_item_norms": lambda w: features.factor_norms(w.item_factors, "item_id"),
    }

    def __init__(self, world: World) -> None:
        self.world = world
        self.stored: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.stored:
            self.stored[name] = write_stage(self.BUILD[name](self.world), name)
        return self.stored[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.BUILD)

    def __len__(self) -> int:
        return len(self.BUILD)


class PurchaseWorld(World):
    """The same stages on the larger purchase log, with its last 30 days as labels."""

    _known: dict[tuple[str, str], World] = {}

    @cached_property
    def raw(self) -> DataFrame:
        return purchases_log(self.table)

    @cached_property
    def cutoff(self) -> datetime:
        return interactions.infer_cutoff(self.raw).first()["cutoff"] - timedelta(days=29)


class EarlyFold:
    """A fold near the start of the purchase log, where many items are still unknown."""

    def __init__(self, world: World) -> None:
        self.world = world

    @cached_property
    def raw(self) -> DataFrame:
        return write_stage(purchases_log(self.world.table), "purchases")

    @cached_property
    def cutoff(self) -> datetime:
        return self.raw.agg(F.min("date").alias("first")).first()["first"] + timedelta(days=120)

    @cached_property
    def end(self) -> datetime:
        return self.cutoff + timedelta(days=30)

    @cached_property
    def daily(self) -> tuple[DataFrame, DataFrame]:
        sides = interactions.split_interactions(self.raw, self.cutoff, self.end)
        return tuple(write_stage(interactions.aggregate_daily(side), "early") for side in sides)

    @cached_property
    def targets(self) -> DataFrame:
        """Customers that the customer table lists in the building segment."""
        rows_ = self.world.table("customer").filter(F.col("c_mktsegment") == "BUILDING")
        return rows_.select(F.col("c_custkey").alias("user_id"))

    @cached_property
    def truth(self) -> interactions.GroundTruth:
        return interactions.ground_truth(*self.daily, self.targets)
