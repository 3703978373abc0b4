"""Global and recency popularity, list building and fallback filling."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.expressions import age_hours, half_life_decay, total_of
from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.ranking import bounded_rank, global_rank, top_rows
from morrow.operators.interactions import known_items, seen_pairs
from morrow.schemas import PAIR_KEYS

# Names of the four global popularity definitions.
POPULARITY_SCORES = (
    "raw_interaction_count",
    "distinct_interacting_users",
    "relevant_interaction_count",
    "distinct_relevant_users",
)
# Names of the recency signals and score families.
RECENCY_SIGNALS = ("raw_views", "positive_daily_rows")

GLOBAL_SOURCE = "global_popularity"
RECENCY_SOURCE = "recency_popularity"


def item_popularity(daily: DataFrame) -> DataFrame:
    """The four popularity counters of every item.

    Collapsing to (item, user) first replaces two distinct counts by plain sums and
    spreads a hot item over its users.
    """
    pairs = daily.groupBy("item_id", "user_id").agg(
        F.sum("views").alias("views"),
        F.sum("is_positive").alias("positive_rows"),
        F.max("is_positive").alias("positive_user"),
    )
    return pairs.groupBy("item_id").agg(
        F.sum("views").alias("raw_interaction_count"),
        F.count(F.lit(1)).alias("distinct_interacting_users"),
        F.sum("positive_rows").alias("relevant_interaction_count"),
        F.sum("positive_user").cast("bigint").alias("distinct_relevant_users"),
    )


def _label(hours: float | None) -> str:
    return "full" if hours is None else f"{hours:g}h".replace(".", "p")


def window_column(signal: str, hours: float | None) -> str:
    return f"{signal}_window_{_label(hours)}"


def decay_column(signal: str, half_life: float) -> str:
    return f"{signal}_decay_{_label(half_life)}"


def recency_statistics(
    daily: DataFrame,
    reference: datetime | Column,
    windows: Iterable[float],
    half_lives: Iterable[float],
) -> DataFrame:
    """The whole grid of windowed and decayed sums in one aggregation."""
    hours = age_hours("dt", reference)
    sums = []
    for signal, value in (("raw_views", "views"), ("positive_daily_rows", "is_positive")):
        amount = F.col(value).cast("double")
        sums.append(F.sum(amount).alias(window_column(signal, None)))
        for window in windows:
            inside = F.when(hours <= float(window), amount).otherwise(0.0)
            sums.append(F.sum(inside).alias(window_column(signal, window)))
        for half_life in half_lives:
            faded = amount * half_life_decay(hours, half_life)
            sums.append(F.sum(faded).alias(decay_column(signal, half_life)))
    return daily.groupBy("item_id").agg(*sums)


def history_span_hours(daily: DataFrame, reference: datetime | Column) -> DataFrame:
    """One row: hours from the first interaction to the reference time."""
    first = daily.agg(F.min("dt").alias("first"))
    return first.select(age_hours("first", reference).alias("history_span_hours"))


def _positive(name: str, value: float) -> None:
    if not (math.isfinite(value) and value > 0):
        raise ValueError(f"{name} must be positive and finite")


@dataclass(frozen=True)
class WindowViews:
    """Score: the signal inside one window, or in the whole history."""

    signal: str = "raw_views"
    hours: float | None = None

    def __post_init__(self) -> None:
        if self.hours is not None:
            _positive("hours", self.hours)

    def grid(self) -> tuple[set[float], set[float]]:
        """Windows and half-lives that the statistics must hold."""
        return {self.hours} - {None}, set()

    def score(self, span_hours: Column) -> Column:
        return F.col(window_column(self.signal, self.hours))


@dataclass(frozen=True)
class DecayedViews:
    """Score: the signal, halved with every ``half_life`` of age."""

    half_life: float
    signal: str = "raw_views"

    def __post_init__(self) -> None:
        _positive("half_life", self.half_life)

    def grid(self) -> tuple[set[float], set[float]]:
        return set(), {self.half_life}

    def score(self, span_hours: Column) -> Column:
        return F.col(decay_column(self.signal, self.half_life))


@dataclass(frozen=True)
class BlendedViews:
    """Score: a weighted sum over windows (None: the whole history)."""

    weights: Mapping[float | None, float]
    signal: str = "raw_views"

    def __post_init__(self) -> None:
        if not self.weights:
            raise ValueError("a blend needs weights")
        for hours, weight in self.weights.items():
            _positive("weight", weight)
            if hours is not None:
                _positive("hours", hours)

    def grid(self) -> tuple[set[float], set[float]]:
        return set(self.weights) - {None}, set()

    def score(self, span_hours: Column) -> Column:
        return total_of(
            F.col(window_column(self.signal, hours)) * F.lit(float(weight))
            for hours, weight in self.weights.items()
        )


@dataclass(frozen=True)
class TrendingViews:
    """Score: a short window against a long one, both cut to the span of the history."""

    short: float
    long: float
    smoothing: float
    signal: str = "raw_views"

    def __post_init__(self) -> None:
        for name in ("short", "long", "smoothing"):
            _positive(name, getattr(self, name))
        if self.short >= self.long:
            raise ValueError("the short window must be below the long window")

    def grid(self) -> tuple[set[float], set[float]]:
        return {self.short, self.long}, set()

    def score(self, span_hours: Column) -> Column:
        short, long = (F.col(window_column(self.signal, h)) for h in (self.short, self.long))
        cut = [F.least(F.lit(float(h)), span_hours) for h in (self.short, self.long)]
        share = F.least(F.lit(1.0), cut[0] / cut[1])
        alpha = F.lit(float(self.smoothing))
        return F.log1p(short) * ((short + alpha * share) / (long + alpha) / share)


Recency = WindowViews | DecayedViews | BlendedViews | TrendingViews


def rank_items(stats: DataFrame, score: Column, *, positive_only: bool = False) -> DataFrame:
    """Total order of the catalogue: score descending, then item."""
    scored = stats.select("item_id", score.cast("double").alias("score"))
    if positive_only:
        scored = scored.filter(F.col("score") > 0)
    ranked = global_rank(scored, [F.desc("score"), F.asc("item_id")], "global_rank")
    return ranked.select("item_id", "score", "global_rank")


def fit_global_popularity(daily: DataFrame, score: str) -> DataFrame:
    if score not in POPULARITY_SCORES:
        raise ValueError(f"score must be one of {POPULARITY_SCORES}")
    return rank_items(item_popularity(daily), F.col(score))


def fit_recency_popularity(
    daily: DataFrame, reference: datetime | Column, config: Recency
) -> DataFrame:
    windows, half_lives = config.grid()
    stats = recency_statistics(daily, reference, sorted(windows), sorted(half_lives))
    trending = isinstance(config, TrendingViews)
    span = history_span_hours(daily, reference).scalar() if trending else F.lit(None)
    return rank_items(stats, config.score(span), positive_only=True)


#: Catalogue positions whose seen ones are gathered in one list.
SEEN_BLOCK = 4096


def recommend_unseen(
    ranking: DataFrame, seen: DataFrame, target_users: DataFrame, k: int, source: str
) -> DataFrame:
    """The ``k`` best-ranked items each target has not seen.

    Seen items become ranks, gathered per user and block of ranks.  The first unseen
    ranks of a block follow from its list; blocks count up to the first one of which
    the user has seen nothing, as that one fills every free slot.  Users never meet the
    catalogue, only the ``k`` ranks they receive, and no list is longer than a block.
    Lists of items are shorter where the ranking ends first.
    """
    users = target_users.select("user_id")
    width = max(SEEN_BLOCK, k)
    scope = lookup_join(seen.select(*PAIR_KEYS), users, "user_id", "left_semi")
    positions = lookup_join(
        scope, ranking.select("item_id", F.col("global_rank").alias("position")), "item_id", "inner"
    )
    end = ranking.agg(F.coalesce(F.max("global_rank"), F.lit(0)).cast("bigint")).scalar()
    block = F.floor((F.col("position") - 1) / width)
    held = positions.groupBy("user_id", block.alias("block")).agg(
        F.collect_set(F.col("position").cast("bigint")).alias("seen")
    )
    start = F.col("block") * width
    stop = F.least(start + width, end)
    near = F.sequence(start + 1, F.least(start + F.size("seen") + k, stop))
    free = held.select(
        "user_id",
        "block",
        (stop - start - F.size("seen")).alias("free"),
        F.slice(F.array_except(near, "seen"), 1, k).alias("unseen"),
    )
    # A window partition holds one row per block of the ranking.
    order = Window.partitionBy("user_id").orderBy("block")
    earlier = F.coalesce(F.sum("free").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leading = free.select(
        "*", (F.row_number().over(order) - 1).alias("turn"), earlier.alias("earlier")
    ).filter(F.col("block") == F.col("turn"))
    entry = F.when((F.col("earlier") < k) & (F.col("free") > 0), F.struct("block", "unseen"))
    lists = leading.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.array_sort(F.collect_list(entry)).alias("parts")
    )
    joined = lookup_join(users, lists.hint("merge"), "user_id")
    untouched = F.coalesce("blocks", F.lit(0)) * width
    rest = F.when(
        untouched < end, F.sequence(untouched + 1, F.least(untouched + k, end))
    ).otherwise(F.array().cast("array<bigint>"))
    found = F.concat(
        F.coalesce(F.flatten("parts.unseen"), F.array().cast("array<bigint>")), rest
    )
    placed = joined.select(
        "user_id", F.posexplode(F.slice(found, 1, k)).alias("place", "global_rank")
    ).select("user_id", (F.col("place") + 1).alias("rank"), "global_rank")
    return lookup_join(placed, ranking, "global_rank", "inner").select(
        "user_id", "item_id", "score", "rank", F.lit(source).alias("source")
    )


def short_users(candidates: DataFrame, target_users: DataFrame, k: int) -> DataFrame:
    """Targets with a list length other than ``k``; empty when the exact-k rule holds."""
    counts = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("count"))
    return (
        target_users.select("user_id")
        .join(counts, "user_id", "left")
        .select("user_id", F.coalesce("count", F.lit(0)).alias("count"))
        .filter(F.col("count") != k)
    )


def seen_item_lists(seen: DataFrame, target_users: DataFrame) -> DataFrame:
    """Sorted distinct items per target, empty when there are none.

    A reporting table: prediction works on the pair rows and never builds it.
    """
    users = target_users.select("user_id")
    lists = (
        lookup_join(seen, users, "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_set("item_id")).alias("seen_item_ids"))
    )
    empty = F.array().cast("array<int>")
    return users.join(lists, "user_id", "left").withColumn(
        "seen_item_ids", F.coalesce("seen_item_ids", empty)
    )


def ordered_lists(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """One ordered item list per user from at most k rows per user."""
    entries = F.array_sort(F.collect_list(F.struct(rank, "item_id")))
    return (
        rows.groupBy("user_id")
        .agg(entries.alias("entries"))
        .select("user_id", F.col("entries.item_id").alias("item_ids"))
    )


def candidates_to_lists(candidates: DataFrame, k: int = 20) -> DataFrame:
    return ordered_lists(candidates.filter(F.col("rank") <= k))


def list_pairs(recommendations: DataFrame) -> DataFrame:
    """Back from lists to (user, item) rows; empty lists and null items vanish."""
    items = F.array_compact(F.col("item_ids").cast("array<int>"))
    return recommendations.select("user_id", F.explode(items).alias("item_id"))


def by_priority(*sources: DataFrame) -> DataFrame:
    """Union of candidate tables tagged by their position in the argument list."""
    tagged = None
    for priority, rows in enumerate(sources):
        part = rows.withColumn("priority", F.lit(priority))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def first_per_pair(tagged: DataFrame) -> DataFrame:
    """Keep one row per pair: lowest priority, rank, then higher score.

    A minimum over a struct combines before the shuffle, unlike a window.
    """
    kept = [name for name in tagged.columns if name not in (*PAIR_KEYS, "priority", "rank", "score")]
    best = F.min(F.struct("priority", "rank", (-F.col("score")).alias("worse"), *kept))
    return (
        tagged.groupBy(*PAIR_KEYS)
        .agg(best.alias("best"))
        .select(
            *PAIR_KEYS,
            "best.priority",
            "best.rank",
            (-F.col("best.worse")).alias("score"),
            *[f"best.{name}" for name in kept],
        )
    )


def final_ranks(deduplicated: DataFrame, k: int) -> DataFrame:
    """First ``k`` rows per user by priority, rank, score and item."""
    order = [F.asc("priority"), F.asc("rank"), F.desc("score"), F.asc("item_id")]
    return top_rows(deduplicated, "user_id", order, k, "final_rank")


def fill_with_popularity(
    primary: DataFrame,
    popular: DataFrame,
    target_users: DataFrame,
    history: DataFrame,
    k: int = 20,
) -> DataFrame:
    """Primary rows first, popularity in the free slots; known and unseen items only."""
    users = target_users.select("user_id")
    rows = lookup_join(by_priority(primary, popular), users, "user_id", "left_semi")
    rows = lookup_join(first_per_pair(rows), known_items(history), "item_id", "left_semi")
    rows = pair_join(rows, seen_pairs(history), "left_anti")
    return final_ranks(rows, k)


def fallback_usage(recommendations: DataFrame, primary: DataFrame) -> DataFrame:
    """Positions and users of the final lists that the primary source did not supply."""
    missing = pair_join(
        list_pairs(recommendations), primary.select(*PAIR_KEYS), "left_anti"
    )
    return missing.agg(
        F.count(F.lit(1)).alias("fallback_positions"),
        F.count_distinct("user_id").alias("fallback_users"),
    )


def union_popularity(union: DataFrame) -> DataFrame:
    """The popularity rows of a candidate union as fallback candidates."""
    return union.filter(F.col("generated_by_global_popularity")).select(
        *PAIR_KEYS,
        F.col("generator_score_global_popularity").alias("score"),
        F.col("generator_rank_global_popularity").alias("rank"),
        F.lit("global_popularity_fallback").alias("source"),
    )


def rank_with_fallback(
    ranked: DataFrame, union: DataFrame, target_users: DataFrame, k: int = 20
) -> DataFrame:
    """Final ranked rows: the ranker's top ``k``, then the union's popularity rows."""
    best = ranked.filter(F.col("rank") <= k)
    rows = first_per_pair(by_priority(best, union_popularity(union)))
    rows = lookup_join(rows, target_users.select("user_id"), "user_id", "left_semi")
    return final_ranks(rows, k).select(
        *PAIR_KEYS, F.col("final_rank").alias("rank"), "score", "source"
    )


def fallback_report(
    final_rows: DataFrame, ranked: DataFrame, target_users: DataFrame, k: int = 20
) -> DataFrame:
    """Users, rows and fallback counts of :func:`rank_with_fallback`."""
    primary = (
        ranked.filter(F.col("rank") <= k)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("primary_count"))
    )
    per_user = final_rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("source") == "global_popularity_fallback").alias("filled"),
    )
    joined = (
        target_users.select("user_id")
        .join(primary, "user_id", "left")
        .join(per_user, "user_id", "left")
    )
    return joined.agg(
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_if(F.coalesce("primary_count", F.lit(0)) < k).alias("fallback_users"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("fallback_positions"),
    )


def standalone_top(native: DataFrame, popular: DataFrame, k: int = 20) -> DataFrame:
    """A source in its own order, completed by popularity."""
    return ordered_lists(final_ranks(first_per_pair(by_priority(native, popular)), k), "final_rank")


def restrict_catalogue(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Keep candidates of a catalogue and close the gaps in their ranks.

    A candidate table has at most its own cap of rows per user and source.
    """
    kept = lookup_join(candidates, items.select("item_id"), "item_id", "left_semi")
    return bounded_rank(
        kept.withColumnRenamed("rank", "old_rank"), ["user_id", "source"], [F.asc("old_rank")], "rank"
    ).drop("old_rank")
