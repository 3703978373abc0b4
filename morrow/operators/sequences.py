"""Positive item sequences as rows, and the windows cut from them.

A sequence is stored as (user_id, position, item_id) rows.  Only windows of a fixed
length become arrays, so a user with any number of events stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.functions.hashing import with_pair_uniform
from morrow.functions.joins import lookup_join
from morrow.functions.missing import nth_unseen, unseen_before
from morrow.functions.ranking import bucketed_rank, top_rows
from morrow.operators.factors import index_ids
from morrow.schemas import PAIR_KEYS


def positive_sequences(daily: DataFrame) -> DataFrame:
    """Positive daily rows of each user in time order; repeated items stay."""
    rows = daily.filter(F.col("is_positive") == 1).select("user_id", "item_id", "dt")
    ranked = bucketed_rank(
        rows, "user_id", F.date_trunc("HOUR", "dt"), [F.asc("dt"), F.asc("item_id")], "position"
    )
    return ranked.select("user_id", "position", "item_id")


def sequence_lengths(sequences: DataFrame, users: DataFrame) -> DataFrame:
    """Length per user, zero for users without positives."""
    counts = sequences.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))
    return (
        users.select("user_id")
        .join(counts, "user_id", "left")
        .select("user_id", F.coalesce("length", F.lit(0)).alias("length"))
    )


def length_quantiles(lengths: DataFrame) -> DataFrame:
    """Linear quantiles of the sequence length over all users."""
    points = {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q99": 0.99, "q100": 1.0}
    return lengths.agg(*[F.percentile("length", q).alias(name) for name, q in points.items()])


def eligible_users(lengths: DataFrame, seen: DataFrame, catalogue_size: int | Column) -> DataFrame:
    """Users with at least two positives and at least one unseen item."""
    size = F.lit(catalogue_size) if isinstance(catalogue_size, int) else catalogue_size
    counts = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("seen_items"))
    return (
        lengths.filter(F.col("length") >= 2)
        .join(counts, "user_id", "left")
        .withColumn("seen_items", F.coalesce("seen_items", F.lit(0)))
        .filter(F.col("seen_items") < size)
    )


def _gather(rows: DataFrame, out: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("position", "item_id")))
    return rows.groupBy("user_id").agg(entries.alias("entries")).select(
        "user_id", F.col("entries.item_id").alias(out)
    )


def window_ends(eligible: DataFrame, *, epoch: int, seed: int, max_length: int) -> DataFrame:
    """One hashed end position in [2, length] per user and epoch."""
    drawn = with_pair_uniform(
        eligible.withColumn("epoch", F.lit(epoch)),
        seed=seed,
        fold="sequence_windows",
        item="epoch",
    )
    end = F.floor(F.col("uniform") * (F.col("length") - 1)) + 2
    return drawn.withColumn("end", end).select(
        "user_id", "end", F.least(F.col("end") - 1, F.lit(max_length)).alias("window_length")
    )


def training_windows(sequences: DataFrame, ends: DataFrame) -> DataFrame:
    """Input items and the same items shifted by one as targets."""
    rows = lookup_join(sequences, ends, "user_id", "inner").filter(
        F.col("position").between(F.col("end") - F.col("window_length"), F.col("end"))
    )
    windows = _gather(rows, "items")
    return windows.select(
        "user_id",
        F.slice("items", F.lit(1), F.size("items") - 1).alias("inputs"),
        F.slice("items", F.lit(2), F.size("items") - 1).alias("targets"),
    )


def unseen_negatives(
    windows: DataFrame,
    seen: DataFrame,
    items: DataFrame,
    *,
    draws: int,
    epoch: int,
    seed: int,
) -> DataFrame:
    """Uniform draws, with replacement, from the catalogue minus the seen items.

    A draw is an ordinal among the user's unseen items; the gaps between the seen
    catalogue positions turn it into an item.  No user's unseen set is built.
    """
    catalogue = index_ids(items, "item_id", "position", start=1)
    size = catalogue.agg(F.max("position").alias("n")).scalar()
    positions = lookup_join(seen.select(*PAIR_KEYS), catalogue, "item_id", "inner")
    counts = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("seen_items"))
    slots = windows.select("user_id", F.size("targets").alias("window_length")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.col("window_length") * draws - 1))
    )
    drawn = with_pair_uniform(slots, seed=seed, fold=f"negatives:{epoch}", item="slot")
    free = size - F.coalesce("seen_items", F.lit(0))
    requests = (
        drawn.join(counts, "user_id", "left")
        .filter(free > 0)
        .select("user_id", "slot", (F.floor(F.col("uniform") * free) + 1).alias("ordinal"))
    )
    placed = nth_unseen(unseen_before(positions.select("user_id", "position")), requests)
    placed = placed.withColumn("position", F.col("position").cast("int"))
    return lookup_join(placed, catalogue, "position", "inner").select(
        "user_id",
        (F.floor(F.col("slot") / draws) + 1).cast("int").alias("target_number"),
        (F.col("slot") % draws).cast("int").alias("draw"),
        "item_id",
    )


def prediction_context(sequences: DataFrame, users: DataFrame, length: int) -> DataFrame:
    """The latest ``length`` positives in order, empty for unknown users."""
    wanted = users.select("user_id")
    scope = lookup_join(sequences, wanted, "user_id", "left_semi")
    recent = top_rows(scope, "user_id", [F.desc("position")], length, "recency")
    lists = _gather(recent, "items")
    return wanted.join(lists, "user_id", "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<int>"))
    )
