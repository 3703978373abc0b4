"""Raw events to daily history, fold splits and ground truth."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.expressions import event_indicator, instant, positive, total_of
from morrow.functions.joins import lookup_join
from morrow.schemas import DAILY_KEYS, PAIR_KEYS

ONE_DAY = timedelta(days=1)


def infer_cutoff(raw: DataFrame) -> DataFrame:
    """One row: the moment 24 hours before the last event."""
    return raw.agg((F.max("date") - F.expr("INTERVAL 1 DAY")).alias("cutoff"))


def prediction_times(raw: DataFrame) -> DataFrame:
    """One row: last event, first moment after it, and the end of the next day."""
    tick = F.expr("INTERVAL 1 MICROSECOND")
    return (
        raw.agg(F.max("date").alias("history_end"))
        .withColumn("prediction_start", F.col("history_end") + tick)
        .withColumn(
            "prediction_end_exclusive", F.col("prediction_start") + F.expr("INTERVAL 1 DAY")
        )
    )


def split_interactions(
    raw: DataFrame,
    cutoff: datetime | Column,
    end_exclusive: datetime | Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """History strictly before the cutoff, validation from it on (half-open)."""
    if isinstance(cutoff, datetime) and isinstance(end_exclusive, datetime):
        if end_exclusive <= cutoff:
            raise ValueError("the validation interval must end after the cutoff")
    history = raw.filter(F.col("date") < instant(cutoff))
    validation = raw.filter(F.col("date") >= instant(cutoff))
    if end_exclusive is not None:
        validation = validation.filter(F.col("date") < instant(end_exclusive))
    return history, validation


def rolling_windows(cutoff: datetime, days: int = 3) -> list[tuple[str, datetime, datetime]]:
    """Fold name, cutoff and label end of the folds that precede the main one."""
    starts = [cutoff - ONE_DAY * back for back in range(days, 0, -1)]
    return [(f"rolling_{i}", at, at + ONE_DAY) for i, at in enumerate(starts, 1)]


def rolling_folds(raw: DataFrame, windows: list[tuple[str, datetime, datetime]]) -> DataFrame:
    """Every raw row once per fold and side it belongs to.

    The few folds are array literals of each row, so one scan serves all of them.
    """
    sides = [
        F.when(F.col("date") < instant(cutoff), F.struct(F.lit(fold).alias("fold"), F.lit("history").alias("side")))
        .when(F.col("date") < instant(end), F.struct(F.lit(fold).alias("fold"), F.lit("validation").alias("side")))
        for fold, cutoff, end in windows
    ]
    tagged = raw.withColumn("part", F.explode(F.array_compact(F.array(*sides))))
    return tagged.select("part.fold", "part.side", *raw.columns)


def aggregate_daily(raw: DataFrame) -> DataFrame:
    """One row per user, item and calendar date."""
    grouped = raw.groupBy("user_id", "item_id", F.to_date("date").alias("date")).agg(
        F.min("date").alias("dt"),
        F.count(F.lit(1)).alias("views"),
        F.max("watch_time").alias("watch_time"),
        F.max(event_indicator("like")).alias("is_like"),
        F.max(event_indicator("favorite")).alias("is_favorite"),
    )
    return grouped.withColumn("is_positive", positive().cast("int"))


@dataclass(frozen=True)
class GroundTruth:
    """The stages from next-day positives to the evaluated pairs."""

    positive: DataFrame
    unseen: DataFrame
    cold: DataFrame
    eligible: DataFrame
    target: DataFrame


def seen_pairs(daily: DataFrame) -> DataFrame:
    return daily.select(*PAIR_KEYS).distinct()


def known_items(daily: DataFrame) -> DataFrame:
    return daily.select("item_id").distinct()


def positive_pairs(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col("is_positive") == 1).select(*PAIR_KEYS).distinct()


def ground_truth(
    history: DataFrame, validation: DataFrame, target_users: DataFrame
) -> GroundTruth:
    """Next-day positives that are new to the user, known to history and targeted."""
    positives = positive_pairs(validation)
    items = known_items(history)
    # Only the history of pairs that can be labels matters: filter it by the small
    # positive set first, so the full pair history is never shuffled.
    seen = history.select(*PAIR_KEYS).join(positives, PAIR_KEYS, "left_semi").distinct()
    unseen = positives.join(seen, PAIR_KEYS, "left_anti")
    eligible = lookup_join(unseen, items, "item_id", "left_semi")
    return GroundTruth(
        positive=positives,
        unseen=unseen,
        cold=lookup_join(unseen, items, "item_id", "left_anti"),
        eligible=eligible,
        target=lookup_join(eligible, target_users, "user_id", "left_semi"),
    )


def restrict_truth(truth: DataFrame, history_scope: DataFrame) -> DataFrame:
    """Drop labels whose item is unknown to a smaller history scope."""
    return lookup_join(truth, known_items(history_scope), "item_id", "left_semi")


def limited_history(history: DataFrame, target_users: DataFrame, users: int) -> DataFrame:
    """History of the first ``users`` ids and of every target user."""
    first = history.select("user_id").distinct().orderBy("user_id").limit(users)
    scope = first.unionByName(target_users.select("user_id")).distinct()
    return lookup_join(history, scope, "user_id", "left_semi")


def _null_cells(df: DataFrame) -> Column:
    return F.sum(total_of(F.col(name).isNull().cast("bigint") for name in df.columns))


def raw_summary(raw: DataFrame) -> DataFrame:
    """Rows, distinct users and items, time range and null cells."""
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        _null_cells(raw).alias("null_cells"),
    )


def event_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


def events_per_day(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.to_date("date").alias("date")).agg(F.count(F.lit(1)).alias("rows"))


def target_summary(target_users: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows, distinct ids, nulls and targets without any raw event."""
    active = raw.select("user_id").distinct().withColumn("__active", F.lit(1))
    return lookup_join(target_users, active, "user_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_if(F.col("user_id").isNull()).alias("nulls"),
        F.count_if(F.col("__active").isNull()).alias("missing_from_raw"),
    )


def daily_summary(daily: DataFrame) -> DataFrame:
    """Counts, ranges, nulls and surplus key rows of a daily table."""
    keys = daily.groupBy(*DAILY_KEYS).agg(F.count(F.lit(1)).alias("copies"))
    surplus = keys.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).scalar()
    return daily.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.min("dt").alias("min_dt"),
        F.max("dt").alias("max_dt"),
        _null_cells(daily).alias("null_cells"),
    ).withColumn("duplicate_rows", surplus)


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        _null_cells(pairs).alias("null_cells"),
    )


def truth_funnel(truth: GroundTruth, target_users: DataFrame) -> DataFrame:
    """One row of counts and shares for every ground-truth stage.

    The stages are nested, so each pair is tagged by the stages it reaches and all
    counts come from one aggregation.
    """
    stages = {
        "positive": truth.positive,
        "unseen": truth.unseen,
        "cold": truth.cold,
        "eligible": truth.eligible,
        "target": truth.target,
    }
    tagged = None
    for name, pairs in stages.items():
        part = pairs.select(*PAIR_KEYS, F.lit(name).alias("stage"))
        tagged = part if tagged is None else tagged.unionByName(part)

    def rows(stage: str) -> Column:
        return F.count_if(F.col("stage") == stage)

    def distinct(stage: str, key: str) -> Column:
        return F.count_distinct(F.when(F.col("stage") == stage, F.col(key)))

    counts = tagged.agg(
        rows("positive").alias("positive_unique_pairs"),
        (rows("positive") - rows("unseen")).alias("seen_pairs_removed"),
        rows("unseen").alias("unseen_positive_pairs"),
        rows("cold").alias("cold_pairs_removed"),
        distinct("cold", "item_id").alias("cold_unique_items"),
        rows("eligible").alias("eligible_pairs"),
        distinct("eligible", "user_id").alias("eligible_users"),
        rows("target").alias("target_eligible_pairs"),
        distinct("target", "user_id").alias("target_labeled_users"),
    )
    total = F.col("positive_unique_pairs")
    targets = target_users.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        counts.withColumn(
            "seen_pair_share_of_positive",
            F.when(total > 0, F.col("seen_pairs_removed") / total).otherwise(0.0),
        )
        .withColumn(
            "cold_pair_share_of_positive",
            F.when(total > 0, F.col("cold_pairs_removed") / total).otherwise(0.0),
        )
        .withColumn("target_users", targets)
    )


def entity_profile(daily: DataFrame, entity: str) -> DataFrame:
    """Two-level profile: collapse to pairs, then describe each item or user.

    The 0.3 and 0.8 quantiles take the nearest rank and the median is the middle
    value or the mean of the two.  They are read from the watch-time histogram of
    the entity: a hot entity contributes one row per distinct watch time.
    """
    counterpart = "user_id" if entity == "item_id" else "item_id"
    flags = ("is_like", "is_favorite", "is_positive")
    pairs = daily.groupBy(entity, counterpart).agg(
        F.sum("views").alias("views"),
        F.max("watch_time").alias("watch_time"),
        *[F.max(name).alias(name) for name in flags],
    )
    histogram = pairs.groupBy(entity, "watch_time").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in ("views", *flags)]
    )
    running = Window.partitionBy(entity).orderBy("watch_time")
    placed = histogram.withColumn("through", F.sum("n").over(running)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(entity))
    )

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("through") > index, F.col("watch_time")))

    last = F.col("total") - 1

    def nearest(q: float) -> Column:
        return at(F.floor(last * q + 0.5))

    def mean(name: str) -> Column:
        return F.sum(name) / F.sum("n")

    return placed.groupBy(entity).agg(
        F.sum("views").alias("views"),
        mean("views").alias("avg_views"),
        (F.sum(F.col("watch_time") * F.col("n")) / F.sum("n")).alias("avg_watch_time"),
        nearest(0.3).alias("p3_watch_time"),
        nearest(0.8).alias("p8_watch_time"),
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median_watch_time"),
        F.sum("is_like").alias("likes"),
        F.sum("is_favorite").alias("favorites"),
        F.sum("is_positive").alias("positives"),
        mean("is_like").alias("like_rate"),
        mean("is_favorite").alias("favorite_rate"),
        mean("is_positive").alias("positive_rate"),
    )
