"""Final lists from ranker scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from morrow.functions.stages import write_stage
from morrow.operators.popularity import fallback_report, ordered_lists, rank_with_fallback
from morrow.operators.rankers import rank_scores


def final_lists(
    scores: DataFrame, union: DataFrame, target_users: DataFrame, k: int = 20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists, their long rows and the fallback report."""
    ranked = rank_scores(scores, k, "ranker")
    rows = write_stage(rank_with_fallback(ranked, union, target_users, k), "final")
    return ordered_lists(rows), rows, fallback_report(rows, ranked, target_users, k)
