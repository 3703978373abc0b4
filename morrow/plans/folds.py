"""Fold preparation."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from morrow.operators.interactions import (
    GroundTruth,
    aggregate_daily,
    daily_summary,
    event_counts,
    ground_truth,
    infer_cutoff,
    pair_summary,
    prediction_times,
    raw_summary,
    split_interactions,
    target_summary,
    truth_funnel,
)
from morrow.schemas import DAILY_KEYS, PAIR_KEYS
from morrow.sources.tables import write_sorted


@dataclass(frozen=True)
class Fold:
    cutoff: datetime
    history: DataFrame
    validation: DataFrame
    truth: GroundTruth
    target_users: DataFrame


def prepare_fold(
    raw: DataFrame,
    target_users: DataFrame,
    folder: str,
    *,
    cutoff: datetime | None = None,
    end_exclusive: datetime | None = None,
) -> Fold:
    """Split, aggregate and label one fold and write its five tables.

    The daily tables are the stage boundary: later steps read them back in key
    order, and each side of the raw log is aggregated once.
    """
    spark: SparkSession = raw.sparkSession
    if cutoff is None:
        cutoff = infer_cutoff(raw).first()["cutoff"]
    history_raw, validation_raw = split_interactions(raw, cutoff, end_exclusive)
    for name, side in (("history_daily", history_raw), ("validation_daily", validation_raw)):
        write_sorted(aggregate_daily(side), f"{folder}/{name}", DAILY_KEYS)
    history = spark.read.parquet(f"{folder}/history_daily")
    validation = spark.read.parquet(f"{folder}/validation_daily")
    truth = ground_truth(history, validation, target_users)
    write_sorted(truth.eligible, f"{folder}/ground_truth", PAIR_KEYS)
    write_sorted(truth.target, f"{folder}/target_ground_truth", PAIR_KEYS)
    write_sorted(target_users.select("user_id"), f"{folder}/target_users", ["user_id"])
    return Fold(cutoff, history, validation, truth, spark.read.parquet(f"{folder}/target_users"))


def fold_reports(raw: DataFrame, fold: Fold) -> dict[str, DataFrame]:
    """Diagnostics of a prepared fold."""
    return {
        "raw": raw_summary(raw),
        "events": event_counts(raw),
        "targets": target_summary(fold.target_users, raw),
        "history": daily_summary(fold.history),
        "validation": daily_summary(fold.validation),
        "truth": pair_summary(fold.truth.target),
        "funnel": truth_funnel(fold.truth, fold.target_users),
    }


def full_history(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All raw events as daily history, and the prediction window after them."""
    return aggregate_daily(raw), prediction_times(raw)
