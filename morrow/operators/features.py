"""History, co-visitation and factor features of candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.expressions import age_hours, safe_ratio, total_of, zero_sentinels
from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.vectors import norm
from morrow.operators.covisit import covisit_evidence
from morrow.operators.union import cross_available, cross_score
from morrow.schemas import PAIR_KEYS

_EVENTS = {"interaction": None, "positive": "is_positive", "like": "is_like", "favorite": "is_favorite"}
_SIGNALS = {"positive": "is_positive", "like": "is_like", "favorite": "is_favorite"}
_COUNTERPART_STEMS = {"positive": "is_positive", "liked": "is_like", "favorited": "is_favorite"}


@dataclass(frozen=True)
class FeatureWindows:
    """Look-back windows in hours and those that are compared with the one before."""

    windows: tuple[float, ...] = (6.0, 24.0, 72.0)
    trends: tuple[float, ...] = (6.0, 24.0)

    def __post_init__(self) -> None:
        for name, values in (("windows", self.windows), ("trends", self.trends)):
            if not values or any(v <= 0 for v in values) or list(values) != sorted(set(values)):
                raise ValueError(f"{name} must be positive, unique and ascending")
        if set(self.trends) - set(self.windows):
            raise ValueError("trend windows must also be feature windows")


def window_token(hours: float) -> str:
    return f"{hours:g}h".replace(".", "p")


@dataclass(frozen=True)
class _Slice:
    """A half-open age interval (upper bound inclusive) and its column suffix."""

    suffix: str
    newest: float
    oldest: float

    def contains(self, age: Column) -> Column:
        return (age > self.newest) & (age <= self.oldest)


def _slices(config: FeatureWindows, with_trends: bool) -> list[_Slice]:
    slices = [_Slice(window_token(h), 0.0, h) for h in config.windows]
    if with_trends:
        slices += [_Slice(f"prev_{window_token(h)}", h, 2 * h) for h in config.trends]
    return slices


def entity_features(
    daily: DataFrame,
    entity: str,
    cutoff: datetime | Column,
    config: FeatureWindows = FeatureWindows(),
    *,
    trends: bool = False,
) -> DataFrame:
    """Lifetime, window and trend features of users or items.

    Three aggregations that all combine before their shuffle, so a hot entity never
    gathers its rows in one task: additive sums per entity; distinct counterparts
    from one bit mask per (entity, counterpart) instead of a distinct aggregate per
    count; active days from distinct (entity, date).
    """
    counterpart = "item_id" if entity == "user_id" else "user_id"
    prefix, plural = entity[: -len("_id")], counterpart[: -len("_id")] + "s"
    slices = _slices(config, trends)
    age = age_hours("dt", cutoff)
    totals = daily.groupBy(entity).agg(*_additive(prefix, slices, age))

    marks = {f"{stem}_{plural}_all": F.col(flag) > 0 for stem, flag in _COUNTERPART_STEMS.items()}
    marks |= {f"distinct_{plural}_{part.suffix}": part.contains(age) for part in slices}
    bits = {name: 1 << place for place, name in enumerate(marks)}
    mask = total_of(
        F.when(marks[name], F.lit(bit)).otherwise(0).cast("bigint") for name, bit in bits.items()
    )
    pairs = daily.groupBy(entity, counterpart).agg(F.bit_or(mask).alias("mask"))
    distinct = pairs.groupBy(entity).agg(
        F.count(F.lit(1)).alias(f"{prefix}_distinct_{plural}_all"),
        *[
            F.count_if(F.col("mask").bitwiseAND(F.lit(bit).cast("bigint")) != 0).alias(
                f"{prefix}_{name}"
            )
            for name, bit in bits.items()
        ],
    )
    days = (
        daily.select(entity, "date")
        .distinct()
        .groupBy(entity)
        .agg(F.count(F.lit(1)).cast("int").alias(f"{prefix}_active_days_all"))
    )
    return (
        totals.join(distinct, entity)
        .join(days, entity)
        .select(entity, *_derived(prefix, plural, slices, cutoff, config, trends))
    )


def _additive(prefix: str, slices: list[_Slice], age: Column) -> list[Column]:
    """Sums, maxima and last moments over the lifetime and each slice."""

    def named(value: Column, stem: str, suffix: str) -> Column:
        return value.alias(f"{prefix}_{stem}_{suffix}")

    columns = [named(F.count(F.lit(1)), "daily_rows", "all"), named(F.sum("views"), "views", "all")]
    columns += [named(F.sum(flag), f"{signal}_rows", "all") for signal, flag in _SIGNALS.items()]
    columns += [
        named(F.sum("watch_time"), "watch_time_sum", "all"),
        named(F.max("watch_time"), "watch_time_max", "all"),
    ]
    for event, flag in _EVENTS.items():
        moment = F.col("dt") if flag is None else F.when(F.col(flag) > 0, F.col("dt"))
        columns.append(F.max(moment).alias(f"__last_{event}"))
    for part in slices:
        inside = part.contains(age)

        def within(name: str) -> Column:
            return F.when(inside, F.col(name)).otherwise(0)

        columns += [
            named(F.count_if(inside), "daily_rows", part.suffix),
            named(F.sum(within("views")), "views", part.suffix),
        ]
        columns += [
            named(F.sum(within(flag)), f"{signal}_rows", part.suffix)
            for signal, flag in _SIGNALS.items()
        ]
        columns += [
            named(F.sum(within("watch_time")), "watch_time_sum", part.suffix),
            # A negative watch time must not lose against rows outside the slice.
            named(
                F.coalesce(F.max(F.when(inside, F.col("watch_time"))), F.lit(0)),
                "watch_time_max",
                part.suffix,
            ),
        ]
    return columns


def _derived(
    prefix: str,
    plural: str,
    slices: list[_Slice],
    cutoff: datetime | Column,
    config: FeatureWindows,
    trends: bool,
) -> list[Column]:
    def name(stem: str, suffix: str) -> str:
        return f"{prefix}_{stem}_{suffix}"

    def ratio(out: str, top: str, bottom: str) -> Column:
        return safe_ratio(top, bottom).cast("float").alias(f"{prefix}_{out}")

    columns = [
        F.col(name(stem, "all"))
        for stem in (
            "daily_rows", "views", f"distinct_{plural}", "active_days", "positive_rows",
            "like_rows", "favorite_rows", f"positive_{plural}", f"liked_{plural}",
            f"favorited_{plural}",
        )
    ]
    columns += [
        ratio("watch_time_mean_all", name("watch_time_sum", "all"), name("daily_rows", "all")),
        F.col(name("watch_time_max", "all")),
    ]
    for part in slices:
        columns += [
            F.col(name(stem, part.suffix))
            for stem in (
                "daily_rows", "views", f"distinct_{plural}", "positive_rows", "like_rows",
                "favorite_rows",
            )
        ]
        columns += [
            ratio(
                f"watch_time_mean_{part.suffix}",
                name("watch_time_sum", part.suffix),
                name("daily_rows", part.suffix),
            ),
            F.col(name("watch_time_max", part.suffix)),
        ]
    columns.append(F.lit(True).alias(f"{prefix}_history_available"))
    for signal in _SIGNALS:
        columns.append(
            ratio(f"{signal}_daily_rate_all", name(f"{signal}_rows", "all"), name("daily_rows", "all"))
        )
    for rate, stem in (("positive", "positive"), ("like", "liked"), ("favorite", "favorited")):
        columns.append(
            ratio(
                f"{rate}_counterpart_rate_all",
                name(f"{stem}_{plural}", "all"),
                name(f"distinct_{plural}", "all"),
            )
        )
    for hours in config.windows:
        token = window_token(hours)
        for signal in _SIGNALS:
            columns.append(
                ratio(
                    f"{signal}_daily_rate_{token}",
                    name(f"{signal}_rows", token),
                    name("daily_rows", token),
                )
            )
        columns += [
            ratio(f"daily_row_share_{token}", name("daily_rows", token), name("daily_rows", "all")),
            ratio(f"view_share_{token}", name("views", token), name("views", "all")),
        ]
    for event in _EVENTS:
        last = F.col(f"__last_{event}")
        columns += [
            last.isNotNull().alias(f"{prefix}_last_{event}_available"),
            F.coalesce(age_hours(last, cutoff), F.lit(0.0))
            .cast("float")
            .alias(f"{prefix}_hours_since_last_{event}"),
        ]
    if trends:
        for hours in config.trends:
            token = window_token(hours)
            for stem in ("daily_rows", "views", "positive_rows"):
                now, before = F.col(name(stem, token)), F.col(name(stem, f"prev_{token}"))
                columns.append(
                    (F.log1p(now.cast("double")) - F.log1p(before.cast("double")))
                    .cast("float")
                    .alias(f"{prefix}_trend_{stem}_log_ratio_{token}")
                )
    return columns


def user_features(
    daily: DataFrame, cutoff: datetime | Column, config: FeatureWindows = FeatureWindows()
) -> DataFrame:
    return entity_features(daily, "user_id", cutoff, config)


def item_features(
    daily: DataFrame, cutoff: datetime | Column, config: FeatureWindows = FeatureWindows()
) -> DataFrame:
    return entity_features(daily, "item_id", cutoff, config, trends=True)


def _packed(lookup: DataFrame, key: str, name: str) -> DataFrame:
    """A lookup with its feature columns in one struct: joins move one column."""
    return lookup.select(key, F.struct(*[c for c in lookup.columns if c != key]).alias(name))


def attach_history_features(
    candidates: DataFrame, users: DataFrame, items: DataFrame
) -> DataFrame:
    """User features (zero without history) and item features for every pair.

    Items without history keep null features; ``missing_item_lookups`` reports them.
    The users' table is wide and its files compress well, so their size says little about
    a broadcast: it is joined by a shuffle, which the ranks per user have mostly done.
    """
    wide = _packed(users, "user_id", "__user").hint("merge")
    joined = lookup_join(candidates, wide, "user_id")
    joined = lookup_join(joined, _packed(items, "item_id", "__item"), "item_id")
    unpacked = joined.select(*candidates.columns, "__user.*", "__item.*")
    return zero_sentinels(unpacked, [c for c in users.columns if c != "user_id"])


def attach_score_ranks(union: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Rank the available cross scores inside each user's union, item id on ties.

    The window partition is one user's union, which the total cap bounds.
    """
    result = union
    for source in sources:
        there = F.col(cross_available(source))
        order = Window.partitionBy("user_id").orderBy(
            F.desc(there.cast("int")), F.desc(cross_score(source)), F.asc("item_id")
        )
        whole = Window.partitionBy("user_id")
        rank = F.when(there, F.row_number().over(order)).otherwise(0)
        size = F.count_if(there).over(whole)
        result = result.withColumn(f"union_rank_cross_score_{source}", rank).withColumn(
            f"union_rank_norm_cross_score_{source}",
            F.when(
                there,
                (size - F.col(f"union_rank_cross_score_{source}") + 1).cast("double")
                / size.cast("double"),
            )
            .otherwise(0.0)
            .cast("float"),
        )
    return result


def attach_covisit_features(candidates: DataFrame, contributions: DataFrame) -> DataFrame:
    """Co-visitation evidence for existing pairs, zero where there is none."""
    evidence = covisit_evidence(contributions)
    joined = pair_join(candidates, evidence, "left")
    filled = zero_sentinels(joined, [c for c in evidence.columns if c not in PAIR_KEYS])
    return filled.withColumn("covisit_available", F.col("covisit_matched_seed_count") > 0)


def factor_norms(factors: DataFrame, key: str
) -> DataFrame:
    """L2 norm of every user or item factor."""
    side = "user" if key == "user_id" else "item"
    return factors.select(key, norm("features").cast("float").alias(f"als_{side}_factor_norm"))


def attach_factor_features(
    candidates: DataFrame, user_norms: DataFrame, item_norms: DataFrame
) -> DataFrame:
    """Norms, their product and the cosine of the factor product."""
    joined = lookup_join(lookup_join(candidates, user_norms, "user_id"), item_norms, "item_id")
    user, item = F.col("als_user_factor_norm"), F.col("als_item_factor_norm")
    filled = joined.withColumn(
        "als_mapping_available", user.isNotNull() & item.isNotNull()
    ).withColumns(
        {
            "als_user_factor_norm": F.coalesce(user, F.lit(0.0).cast("float")),
            "als_item_factor_norm": F.coalesce(item, F.lit(0.0).cast("float")),
        }
    )
    product = (user.cast("double") * item.cast("double")).cast("float")
    usable = (
        F.col("als_mapping_available")
        & (F.col("als_factor_norm_product") > 0)
        & F.col(cross_available("implicit_als"))
    )
    cosine = F.col(cross_score("implicit_als")) / F.col("als_factor_norm_product").cast("double")
    return (
        filled.withColumn("als_factor_norm_product", product)
        .withColumn("als_cosine_available", usable)
        .withColumn(
            "als_cosine_similarity",
            F.when(F.col("als_cosine_available"), cosine).otherwise(0.0).cast("float"),
        )
    )
