"""Item co-visitation: history profiles, pair statistics, neighbors and seeds."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.functions.expressions import age_hours, event_strength, half_life_decay
from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.ranking import bucketed_rank, top_rows
from morrow.operators.interactions import seen_pairs
from morrow.schemas import PAIR_KEYS

SOURCE = "item2item"
# Names of the accepted relation options.
PROFILES = ("all", "positive")
DIRECTIONS = ("undirected", "directed")
PAIR_WEIGHTS = ("uniform", "time_decay")
NORMALIZATIONS = ("raw", "cosine", "jaccard")
SEED_STRENGTHS = ("uniform", "event")


@dataclass(frozen=True)
class CovisitConfig:
    """Relation parameters fix the neighbor table; the seed ones act at prediction."""

    profile: str = "all"
    direction: str = "undirected"
    pair_weight: str = "uniform"
    normalization: str = "raw"
    history_cap: int = 10
    pair_half_life_hours: float = 24.0
    min_pair_users: int = 1
    neighbor_k: int = 100
    seed_k: int = 5
    seed_half_life_hours: float | None = 24.0
    seed_strength: str = "uniform"

    def __post_init__(self) -> None:
        choices = {
            "profile": PROFILES,
            "direction": DIRECTIONS,
            "pair_weight": PAIR_WEIGHTS,
            "normalization": NORMALIZATIONS,
            "seed_strength": SEED_STRENGTHS,
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        for name in ("history_cap", "min_pair_users", "neighbor_k", "seed_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.pair_half_life_hours <= 0 or (self.seed_half_life_hours or 1.0) <= 0:
            raise ValueError("half-lives must be positive")
        if self.seed_k > self.history_cap:
            raise ValueError("seed_k must not exceed history_cap")

    def relation(self) -> tuple:
        """The fields that determine the fitted neighbor table."""
        return (
            self.profile,
            self.direction,
            self.pair_weight,
            self.normalization,
            self.history_cap,
            self.pair_half_life_hours,
            self.min_pair_users,
            self.neighbor_k,
        )

    def with_seed_options(self, **changes) -> CovisitConfig:
        """New seed-time parameters for the same neighbor table."""
        changed = replace(self, **changes)
        if changed.relation() != self.relation():
            raise ValueError("a fitted neighbor table keeps its relation parameters")
        return changed


def collapse_history(daily: DataFrame) -> DataFrame:
    """One row per user and item over all days."""
    return daily.groupBy(*PAIR_KEYS).agg(
        F.max("dt").alias("last_dt"),
        F.sum("views").alias("views"),
        F.max("watch_time").alias("watch_time"),
        F.max("is_like").alias("is_like"),
        F.max("is_favorite").alias("is_favorite"),
        F.max("is_positive").alias("is_positive"),
    )


def _recent_first() -> list[Column]:
    return [F.desc("last_dt"), F.asc("item_id")]


def rank_history(collapsed: DataFrame) -> DataFrame:
    """Recency rank of every collapsed row, for users with any number of items.

    Rows are ranked inside (user, hour); earlier hours add their row counts.
    """
    return bucketed_rank(
        collapsed,
        "user_id",
        F.date_trunc("HOUR", "last_dt"),
        _recent_first(),
        "history_rank",
        descending=True,
    )


def recent_items(collapsed: DataFrame, cap: int) -> DataFrame:
    """The latest ``cap`` items of every user with their rank."""
    return top_rows(collapsed, "user_id", _recent_first(), cap, "history_rank")


def profile_rows(collapsed: DataFrame, config: CovisitConfig) -> DataFrame:
    """Recent items used for pairs; the cap applies before the positive filter."""
    rows = recent_items(collapsed, config.history_cap)
    if config.profile == "positive":
        rows = rows.filter(F.col("is_positive") == 1)
    return rows


def item_user_counts(profile: DataFrame) -> DataFrame:
    """Users per item within the profile (one profile row per user and item)."""
    return profile.groupBy("item_id").agg(F.count(F.lit(1)).alias("users"))


def user_item_pairs(profile: DataFrame) -> DataFrame:
    """Newer and older item of every pair in one user's recent list.

    A list holds at most ``history_cap`` entries, so it is gathered into an array and
    unfolded in place; no self-join and no second shuffle.
    """
    entry = F.struct("history_rank", "item_id", "last_dt")
    lists = profile.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    newer = lists.select("items", F.posexplode("items").alias("position", "newer"))
    older = F.slice("items", F.col("position") + 2, F.size("items"))
    pairs = newer.select("newer", F.explode(older).alias("older"))
    return pairs.select(
        F.col("newer.item_id").alias("newer_item"),
        F.col("older.item_id").alias("older_item"),
        F.timestamp_diff("MICROSECOND", F.col("older.last_dt"), F.col("newer.last_dt")).alias(
            "gap_us"
        ),
    )


def pair_statistics(profile: DataFrame, config: CovisitConfig) -> DataFrame:
    """Weight and number of users of every linked item pair.

    Directed links lead from the older to the strictly newer item.  Undirected
    weights are symmetric: they are summed once per unordered pair and mirrored
    afterwards, which halves the shuffled rows.
    """
    pairs = user_item_pairs(profile)
    if config.pair_weight == "uniform":
        weight = F.lit(1.0)
    else:
        hours = F.col("gap_us").cast("double") / 3_600_000_000.0
        weight = F.pow(F.lit(2.0), -hours / float(config.pair_half_life_hours))
    totals = [F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("co_user_count")]
    if config.direction == "directed":
        links = pairs.filter(F.col("gap_us") > 0).select(
            F.col("older_item").alias("item_id"),
            F.col("newer_item").alias("neighbor_item_id"),
            weight.alias("weight"),
        )
        return links.groupBy("item_id", "neighbor_item_id").agg(*totals)
    halves = (
        pairs.select(
            F.least("newer_item", "older_item").alias("low"),
            F.greatest("newer_item", "older_item").alias("high"),
            weight.alias("weight"),
        )
        .groupBy("low", "high")
        .agg(*totals)
    )
    both = F.array(
        F.struct(F.col("low").alias("item_id"), F.col("high").alias("neighbor_item_id")),
        F.struct(F.col("high").alias("item_id"), F.col("low").alias("neighbor_item_id")),
    )
    return halves.select(F.explode(both).alias("link"), "weight", "co_user_count").select(
        "link.item_id", "link.neighbor_item_id", "weight", "co_user_count"
    )


def normalize_pairs(
    pairs: DataFrame, counts: DataFrame, config: CovisitConfig
) -> DataFrame:
    """Score of every link with enough users."""
    kept = pairs.filter(F.col("co_user_count") >= config.min_pair_users)
    if config.normalization == "raw":
        return kept.withColumnRenamed("weight", "score")
    mine = counts.select("item_id", F.col("users").cast("double").alias("users_a"))
    other = counts.select(
        F.col("item_id").alias("neighbor_item_id"), F.col("users").cast("double").alias("users_b")
    )
    joined = lookup_join(kept, mine, "item_id", "inner")
    joined = lookup_join(joined, other, "neighbor_item_id", "inner")
    a, b = F.col("users_a"), F.col("users_b")
    if config.normalization == "cosine":
        scale = F.sqrt(a * b)
    else:
        scale = a + b - F.col("co_user_count")
    return joined.select(
        "item_id", "neighbor_item_id", (F.col("weight") / scale).alias("score"), "co_user_count"
    )


def top_neighbors(links: DataFrame, neighbor_k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("neighbor_item_id")]
    return top_rows(links, "item_id", order, neighbor_k).select(
        "item_id", "neighbor_item_id", "score", "co_user_count", "rank"
    )


def fit_neighbors(daily: DataFrame, config: CovisitConfig) -> DataFrame:
    """Neighbor table of a daily history."""
    profile = profile_rows(collapse_history(daily), config)
    links = normalize_pairs(
        pair_statistics(profile, config), item_user_counts(profile), config
    )
    return top_neighbors(links, config.neighbor_k)


def prepare_seeds(
    daily: DataFrame, target_users: DataFrame, seed_items: int
) -> tuple[DataFrame, DataFrame]:
    """Latest items and all seen pairs of the target users."""
    scope = lookup_join(daily, target_users.select("user_id"), "user_id", "left_semi")
    return recent_items(collapse_history(scope), seed_items), seen_pairs(scope)


def seed_contributions(
    seeds: DataFrame,
    neighbors: DataFrame,
    config: CovisitConfig,
    reference: datetime | Column,
) -> DataFrame:
    """One row per user, seed and neighbor of the seed, with its contribution.

    A viral item is a recent seed of very many users.  Its neighbor list is one
    array row of at most ``neighbor_k`` entries, so the join is many-to-one and the
    hot seed is spread by the lookup join.
    """
    recent = half_life_decay(age_hours("last_dt", reference), config.seed_half_life_hours)
    strength = F.lit(1.0) if config.seed_strength == "uniform" else event_strength()
    active = seeds.filter(F.col("history_rank") <= config.seed_k).select(
        "user_id",
        F.col("item_id").alias("seed_item_id"),
        recent.alias("recency"),
        strength.alias("strength"),
    )
    entry = F.struct("neighbor_item_id", "score", "co_user_count", "rank")
    lists = neighbors.groupBy(F.col("item_id").alias("seed_item_id")).agg(
        F.collect_list(entry).alias("links")
    )
    matched = lookup_join(active, lists, "seed_item_id", "inner")
    return matched.select(
        "user_id", "seed_item_id", "recency", "strength", F.explode("links").alias("link")
    ).select(
        "user_id",
        "seed_item_id",
        F.col("link.neighbor_item_id").alias("item_id"),
        F.col("link.score").alias("neighbor_score"),
        F.col("link.co_user_count").alias("co_user_count"),
        F.col("link.rank").alias("neighbor_rank"),
        (F.col("link.score") * F.col("recency") * F.col("strength")).alias("contribution"),
    )


def best_contribution(contributions: DataFrame, out: str = "score") -> DataFrame:
    return contributions.groupBy(*PAIR_KEYS).agg(F.max("contribution").alias(out))


def recommend_neighbors(
    seeds: DataFrame,
    seen: DataFrame,
    neighbors: DataFrame,
    config: CovisitConfig,
    reference: datetime | Column,
    k: int,
) -> DataFrame:
    """Unseen neighbors of the latest items, best contribution first."""
    scored = best_contribution(seed_contributions(seeds, neighbors, config, reference))
    unseen = pair_join(scored, seen.select(*PAIR_KEYS), "left_anti")
    order = [F.desc("score"), F.asc("item_id")]
    return top_rows(unseen, "user_id", order, k).select(
        *PAIR_KEYS, "score", "rank", F.lit(SOURCE).alias("source")
    )


def covisit_evidence(contributions: DataFrame) -> DataFrame:
    """Ten aggregates of the seed links that lead to each (user, item)."""
    return contributions.groupBy(*PAIR_KEYS).agg(
        F.count(F.lit(1)).cast("int").alias("covisit_matched_seed_count"),
        F.sum("contribution").cast("float").alias("covisit_contribution_sum"),
        F.avg("contribution").cast("float").alias("covisit_contribution_mean"),
        F.max("contribution").alias("covisit_contribution_max"),
        F.sum("neighbor_score").cast("float").alias("covisit_neighbor_score_sum"),
        F.avg("neighbor_score").cast("float").alias("covisit_neighbor_score_mean"),
        F.max("neighbor_score").cast("float").alias("covisit_neighbor_score_max"),
        F.max("co_user_count").alias("covisit_co_user_count_max"),
        F.avg("co_user_count").cast("float").alias("covisit_co_user_count_mean"),
        F.min("neighbor_rank").alias("covisit_best_neighbor_rank"),
    )
