"""Labels, deterministic sampling and training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.expressions import any_of
from morrow.functions.hashing import with_id_hash, with_pair_uniform
from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.ranking import global_rank
from morrow.operators.union import active, generated, generator_rank
from morrow.schemas import PAIR_KEYS

# Training strata, metadata columns and hash stream names.
TRAINING_STRATA = (
    "positive",
    "multi_collaborative_top50",
    "multi_other",
    "single_item2item_top50",
    "single_als_top50",
    "easy_negative",
)
TRAINING_METADATA = ("is_hard_negative", "is_training_sample", "sampling_probability")
FULL_FIT_STREAM = "task11:{fold}"
BACKTEST_STREAM = "task12:train:{fold}"
EVALUATION_USER_STREAM = "task12:eval_users"
EXPANDED_STREAM = "expanded_ranker:{fold}"
TRAINING_FOLDS = ("rolling_1", "rolling_2", "rolling_3", "canonical")
HARD_RANK = 50
EASY_PROBABILITY = 0.05


def assign_labels(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Label 1 for pairs of the ground truth, else 0."""
    marked = truth.select(*PAIR_KEYS, F.lit(1).cast("smallint").alias("label"))
    return candidates.join(marked, PAIR_KEYS, "left").withColumn(
        "label", F.coalesce("label", F.lit(0).cast("smallint"))
    )


@dataclass(frozen=True)
class NegativeSampling:
    seed: int = 42
    easy_probability: float = EASY_PROBABILITY
    hard_rank: int = HARD_RANK
    collaborative: tuple[str, ...] = ("item2item", "implicit_als")
    keep_multisource: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.easy_probability <= 1:
            raise ValueError("easy_probability must be in (0, 1]")
        if self.hard_rank < 1 or not self.collaborative:
            raise ValueError("hard_rank and collaborative sources are required")


def sample_negatives(labeled: DataFrame, fold: str, config: NegativeSampling) -> DataFrame:
    """Mark training rows: all positives and hard negatives, easy ones by hash."""
    hard = [active(source, config.hard_rank) for source in config.collaborative]
    if config.keep_multisource:
        hard.append(F.col("source_count") >= 2)
    hashed = with_pair_uniform(labeled, seed=config.seed, fold=fold, out="__uniform")
    certain = (F.col("label") == 1) | F.col("is_hard_negative")
    return (
        hashed.withColumn("is_hard_negative", (F.col("label") == 0) & any_of(hard))
        .withColumn(
            "is_training_sample", certain | (F.col("__uniform") < config.easy_probability)
        )
        .withColumn(
            "sampling_probability",
            F.when(certain, 1.0).otherwise(config.easy_probability).cast("float"),
        )
        .drop("__uniform")
    )


def training_stratum() -> Column:
    """Name of the sampling stratum of a labeled union row."""
    multi = F.col("source_count") >= 2
    item = F.col(generated("item2item")) & (F.col(generator_rank("item2item")) <= HARD_RANK)
    als = F.col(generated("implicit_als")) & (F.col(generator_rank("implicit_als")) <= HARD_RANK)
    return (
        F.when(F.col("label") == 1, "positive")
        .when(multi & (item | als), "multi_collaborative_top50")
        .when(multi, "multi_other")
        .when(item, "single_item2item_top50")
        .when(als, "single_als_top50")
        .otherwise("easy_negative")
    )


def retained(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_training_sample"))


def _strata(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(name) for name in TRAINING_STRATA])
    return df.sparkSession.range(1).select(F.explode(names).alias("sampling_stratum"))


def stratum_counts(rows: DataFrame) -> DataFrame:
    """Retained rows per stratum; strata without rows count zero."""
    counts = (
        retained(rows)
        .groupBy(training_stratum().alias("sampling_stratum"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return _strata(rows).join(counts, "sampling_stratum", "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0))
    )


def _fold_targets(counts: DataFrame, target_rows: int, folds: Sequence[str]) -> DataFrame:
    """Equal row budgets; the first of ``folds`` take the remainder.  One row per fold.

    A fold that is not listed gets no budget (null), which every check below reports.
    """
    names = list(dict.fromkeys(folds))
    share, left = divmod(target_rows, len(names))
    place = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("fold"))
    budget = F.when(place > 0, F.lit(share) + (place <= left).cast("int"))
    return counts.withColumn("allocated", budget.cast("bigint"))


def _probability(value: Column, what: str) -> Column:
    """The value, where it lies in (0, 1]; evaluating the row fails elsewhere."""
    message = F.concat(F.lit(f"infeasible {what} of fold "), F.col("fold").cast("string"))
    return F.when((value > 0) & (value <= 1), value).otherwise(F.raise_error(message).cast("double"))


def allocate_probabilities(
    counts: DataFrame, target_rows: int, folds: Sequence[str] = TRAINING_FOLDS
) -> DataFrame:
    """Second-stage negative probability per fold from (fold, positives, rows).

    A fold whose budget cannot hold its positives and a negative fails.
    """
    free = F.col("rows") - F.col("positives")
    wanted = (F.col("allocated") - F.col("positives")) / F.nullif(free, F.lit(0))
    capped = F.when(wanted.isNotNull(), F.least(F.lit(1.0), wanted))
    return _fold_targets(counts, target_rows, folds).select(
        "fold",
        F.col("rows").alias("source_rows"),
        F.col("positives").alias("positive_rows"),
        F.least("allocated", "rows").alias("target_rows"),
        _probability(capped, "budget").alias("secondary_negative_probability"),
    )


def infeasible_allocations(
    counts: DataFrame, target_rows: int, folds: Sequence[str] = TRAINING_FOLDS
) -> DataFrame:
    """Folds without budget, or whose budget cannot hold all positives and some negatives."""
    rows = _fold_targets(counts, target_rows, folds)
    short = (F.col("rows") <= F.col("positives")) | (F.col("allocated") <= F.col("positives"))
    return rows.filter(F.col("allocated").isNull() | short).select(
        "fold", "positives", "rows", "allocated"
    )


def fold_totals(counts: DataFrame) -> DataFrame:
    """Rows and positives per fold from counts per fold and stratum."""
    positive = F.when(F.col("sampling_stratum") == "positive", F.col("rows")).otherwise(0)
    return counts.groupBy("fold").agg(
        F.sum("rows").alias("rows"), F.sum(positive).alias("positives")
    )


def infeasible_plan(
    counts: DataFrame, target_rows: int, folds: Sequence[str] = TRAINING_FOLDS
) -> DataFrame:
    """Folds for which ``sampling_plan`` has no probability in (0, 1]."""
    rows = _fold_targets(fold_totals(counts), target_rows, folds)
    fits = (F.col("allocated") > F.col("positives")) & (F.col("allocated") <= F.col("rows"))
    return rows.filter(~F.coalesce(fits, F.lit(False))).select(
        "fold", "positives", "rows", "allocated"
    )


def sampling_plan(
    counts: DataFrame, target_rows: int, folds: Sequence[str] = TRAINING_FOLDS
) -> DataFrame:
    """Inclusion probabilities and weights per fold and stratum.

    ``counts`` has one row per fold and stratum: fold, sampling_stratum, rows.  Rows of a fold
    listed by ``infeasible_plan`` fail when they are evaluated: no weight is ever
    taken from a probability outside (0, 1].
    """
    free = F.nullif(F.col("rows") - F.col("positives"), F.lit(0))
    targets = _fold_targets(fold_totals(counts), target_rows, folds).select(
        "fold",
        F.col("allocated").alias("target_rows"),
        ((F.col("allocated") - F.col("positives")) / free).alias("p"),
    )
    is_positive = F.col("sampling_stratum") == "positive"
    first = F.when(F.col("sampling_stratum") == "easy_negative", EASY_PROBABILITY).otherwise(1.0)
    second = F.when(is_positive, 1.0).otherwise(_probability(F.col("p"), "sampling probability"))
    return counts.join(targets, "fold").select(
        "fold",
        "sampling_stratum",
        F.col("rows").alias("source_rows"),
        "target_rows",
        first.alias("first_stage_probability"),
        second.alias("second_stage_probability"),
        (first * second).alias("full_inclusion_probability"),
        (1.0 / (first * second)).alias("object_weight"),
    )


def second_stage(
    rows: DataFrame,
    *,
    fold: str,
    seed: int,
    negative_probability: float,
    features: Sequence[str],
    stream: str = FULL_FIT_STREAM,
) -> DataFrame:
    """Thin the retained negatives again and weight by the full probability."""
    if not 0 < negative_probability <= 1:
        raise ValueError("negative_probability must be in (0, 1]")
    hashed = with_pair_uniform(
        retained(rows), seed=seed, fold=stream.format(fold=fold), out="__uniform"
    )
    is_positive = F.col("label") == 1
    kept = hashed.filter(is_positive | (F.col("__uniform") < negative_probability))
    second = F.when(is_positive, 1.0).otherwise(negative_probability)
    full = F.col("sampling_probability").cast("double") * second
    return kept.select(
        *PAIR_KEYS,
        F.lit(fold).alias("fold_id"),
        training_stratum().alias("sampling_stratum"),
        "label",
        full.alias("full_sampling_probability"),
        (F.lit(1.0) / full).cast("float").alias("sample_weight"),
        *[F.col(name).cast("float").alias(name) for name in features],
    )


def weighted_rows(
    rows: DataFrame,
    *,
    features: Sequence[str],
    fold: str,
    seed: int,
    negative_probability: float = 1.0,
) -> DataFrame:
    """Label, inverse-probability weight and features of the training rows."""
    sampled = second_stage(
        rows,
        fold=fold,
        seed=seed,
        negative_probability=negative_probability,
        features=features,
        stream="{fold}",
    )
    return sampled.select("label", "sample_weight", *features)


def sample_union(
    union: DataFrame, truth: DataFrame, *, fold: str, seed: int, negative_probability: float
) -> DataFrame:
    """All positives and a uniform share of the negatives with weight 1/p."""
    hashed = with_pair_uniform(
        assign_labels(union, truth),
        seed=seed,
        fold=EXPANDED_STREAM.format(fold=fold),
        out="__uniform",
    )
    is_positive = F.col("label") == 1
    weight = F.when(is_positive, 1.0).otherwise(1.0 / negative_probability).cast("float")
    return (
        hashed.filter(is_positive | (F.col("__uniform") < negative_probability))
        .drop("__uniform")
        .withColumn("sample_weight", weight)
    )


def feature_columns(df: DataFrame) -> list[str]:
    """Model features: every column but ids, label and sampling metadata."""
    excluded = {*PAIR_KEYS, "label", *TRAINING_METADATA, "sample_weight", "fold_id", "sampling_stratum"}
    return [name for name in df.columns if name not in excluded]


def check_feature_names(names: Sequence[str]) -> list[str]:
    """Reject empty, repeated or label-like feature lists."""
    forbidden = {*PAIR_KEYS, "label", *TRAINING_METADATA, "sample_weight"}
    if not names or len(set(names)) != len(names) or forbidden & set(names):
        raise ValueError("features must be unique and must not include ids or labels")
    return list(names)


def float_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*PAIR_KEYS, *[F.col(n).cast("float").alias(n) for n in names])


def dataset_report(rows: DataFrame) -> DataFrame:
    """Class balance and sampling counts of a labeled dataset."""
    kept = F.col("is_training_sample")
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.sum(F.col("label").cast("bigint")).alias("positive_rows"),
        F.count_if(F.col("is_hard_negative")).alias("hard_negative_rows"),
        F.count_if(kept).alias("training_rows"),
        F.count_if(kept & (F.col("label") == 1)).alias("training_positive_rows"),
    )

    def rate(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)

    return (
        counts.withColumn("negative_rows", F.col("rows") - F.col("positive_rows"))
        .withColumn(
            "training_negative_rows", F.col("training_rows") - F.col("training_positive_rows")
        )
        .withColumn("positive_rate", rate("positive_rows", "rows"))
        .withColumn("training_positive_rate", rate("training_positive_rows", "training_rows"))
    )


def group_ids(users: DataFrame) -> DataFrame:
    """Dense group id of every user, in id order."""
    return global_rank(users.select("user_id").distinct(), [F.asc("user_id")], "rank").select(
        "user_id", (F.col("rank") - 1).alias("group_id")
    )


def grouped_rows(
    rows: DataFrame,
    groups: DataFrame,
    features: Sequence[str],
    *,
    training_only: bool = True,
    users: DataFrame | None = None,
) -> DataFrame:
    """Label, group and features; optionally only training rows of some users."""
    source = retained(rows) if training_only else rows
    if users is not None:
        source = lookup_join(source, users.select("user_id"), "user_id", "left_semi")
    return lookup_join(source, groups, "user_id", "inner").select(
        "label",
        "group_id",
        "item_id",
        *[F.col(name).cast("float").alias(name) for name in features],
    )


def group_report(rows: DataFrame) -> DataFrame:
    """Number, label balance and size range of the groups."""
    groups = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.col("label").cast("bigint")).alias("positives")
    )
    return groups.agg(
        F.sum("size").alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("positives").alias("positive_rows"),
        F.count_if(F.col("positives") > 0).alias("positive_groups"),
        F.count_if(F.col("positives") == 0).alias("zero_positive_groups"),
        F.min("size").alias("min_group_size"),
        F.max("size").alias("max_group_size"),
    )


def group_weights(rows: DataFrame) -> DataFrame:
    """Inverse positive count of each group, scaled to mean one over the groups."""
    groups = rows.groupBy("group_id").agg(F.sum(F.col("label").cast("bigint")).alias("positives"))
    raw = groups.withColumn("raw", 1.0 / F.greatest(F.col("positives"), F.lit(1)).cast("double"))
    mean = raw.agg(F.avg("raw").alias("mean")).scalar()
    return raw.select("group_id", "positives", (F.col("raw") / mean).cast("float").alias("group_weight"))


def first_by_hash(users: DataFrame, count: int, hashed: Column | str) -> DataFrame:
    """Smallest ``count`` hashes, id on ties.  A distributed top-n, not a full sort."""
    return users.orderBy(hashed, "user_id").limit(count).select("user_id")


def evaluation_users(users: DataFrame, *, count: int, seed: int) -> DataFrame:
    """Hash-ordered sample of complete users for the backtest."""
    hashed = with_pair_uniform(
        users.select("user_id", F.lit(0).alias("item_id")),
        seed=seed,
        fold=EVALUATION_USER_STREAM,
        out="hash",
    )
    return first_by_hash(hashed, count, "hash")


def complete_query_users(users: DataFrame, *, count: int, seed: int) -> DataFrame:
    """Hash-ordered sample of labeled users for the group ranker."""
    return first_by_hash(with_id_hash(users.select("user_id"), seed=seed, out="hash"), count, "hash")


def evaluation_rows(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Every candidate row of the sampled users."""
    return lookup_join(rows, users.select("user_id"), "user_id", "left_semi")


def thin_users(rows: DataFrame, users: DataFrame, minimum: int) -> DataFrame:
    """Sampled users with fewer than ``minimum`` candidate rows."""
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    return (
        users.select("user_id")
        .join(counts, "user_id", "left")
        .select("user_id", F.coalesce("rows", F.lit(0)).alias("rows"))
        .filter(F.col("rows") < minimum)
    )


def scope_violations(
    cutoffs: Mapping[str, datetime], training: Sequence[str], horizon: datetime
) -> list[str]:
    """Training folds whose label day reaches past the evaluation horizon."""
    day = timedelta(days=1)
    return [fold for fold in training if cutoffs[fold] + day > horizon]


def dropped_positives(labeled: DataFrame, kept: DataFrame) -> DataFrame:
    """Positive pairs that a sampling stage has lost; there must be none."""
    positives = labeled.filter(F.col("label") == 1).select(*PAIR_KEYS)
    return pair_join(positives, kept.select(*PAIR_KEYS), "left_anti")
