"""Choosing between evaluated configurations.

These tables have one row per configuration and fold, so the order of the whole
table is cheap; the metrics in them come from distributed jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.joins import attach_row

LABELED = "precision_at_20_labeled_users"
ALL_TARGETS = "precision_at_20_all_targets"


def aggregate_folds(results: DataFrame, metrics: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Mean, minimum and spread of each metric and totals of counts per configuration."""
    columns = [F.count(F.lit(1)).alias("folds")]
    for name in metrics:
        columns += [
            F.avg(name).alias(f"mean_{name}"),
            F.min(name).alias(f"min_{name}"),
            (F.max(name) - F.min(name)).alias(f"fold_spread_{name}"),
        ]
    columns += [F.sum(name).alias(f"total_{name}") for name in totals]
    return results.groupBy("config_id").agg(*columns)


def incomplete_configs(results: DataFrame, folds: int) -> DataFrame:
    """Configurations that were not evaluated on every fold."""
    counts = results.groupBy("config_id").agg(F.count_distinct("fold").alias("folds"))
    return counts.filter(F.col("folds") != folds)


def choose(table: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first configuration in a lexicographic order."""
    return table.orderBy(*order).limit(1)


def choose_config(summary: DataFrame) -> DataFrame:
    """Best mean precision, then labeled precision, then oracle, then declared order."""
    return choose(
        summary,
        [
            F.desc(f"mean_{ALL_TARGETS}"),
            F.desc(f"mean_{LABELED}"),
            F.desc("mean_candidate_oracle_p20_all_targets"),
            F.asc("priority"),
        ],
    )


def choose_policy(policies: DataFrame) -> DataFrame:
    """Best recall, then oracle precision, then declared order."""
    return choose(
        policies,
        [
            F.desc("candidate_recall"),
            F.desc("candidate_oracle_p20_all_targets"),
            F.asc("priority"),
        ],
    )


def choose_tree_count(curve: DataFrame) -> DataFrame:
    """Most hits, then fewest trees."""
    return choose(curve, [F.desc("final_hits"), F.asc("tree_count")])


def mixed_universes(curve: DataFrame) -> DataFrame:
    """Evaluation universes of a curve beyond the first; empty when there is one."""
    universes = curve.select("target_users", "labeled_users").distinct()
    ordered = Window.orderBy("target_users", "labeled_users")
    return universes.withColumn("n", F.row_number().over(ordered)).filter(F.col("n") > 1).drop("n")


def leaderboard(table: DataFrame, order: Sequence[Column]) -> DataFrame:
    """All configurations with their place in the order."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(*order)))


# Metrics compared in turn; +1 means higher is better, -1 lower.
EPSILON_ORDER = (
    (f"mean_{LABELED}", 1),
    (f"min_{LABELED}", 1),
    (f"fold_spread_{LABELED}", -1),
    (f"mean_{ALL_TARGETS}", 1),
)


def choose_with_epsilon(
    rows: Iterable[Mapping[str, Any]], epsilon: float, order: Sequence[str]
) -> dict[str, Any]:
    """Incumbent is replaced only by a result better by more than epsilon.

    Tie tolerance makes the comparison depend on the evaluation order, so this is a
    fold over the collected fold-aggregate rows: one per configuration, tens at most.
    """
    place = {config: index for index, config in enumerate(order)}
    best: Mapping[str, Any] | None = None
    for row in rows:
        if best is None or _beats(row, best, epsilon, place):
            best = row
    if best is None:
        raise ValueError("there is nothing to choose from")
    return dict(best)


def _beats(
    challenger: Mapping[str, Any],
    incumbent: Mapping[str, Any],
    epsilon: float,
    place: Mapping[str, int],
) -> bool:
    gains = [sign * (challenger[name] - incumbent[name]) for name, sign in EPSILON_ORDER]
    decisive = next((gain for gain in gains if abs(gain) > epsilon), None)
    if decisive is not None:
        return decisive > 0
    trees = incumbent["mean_tree_count"] - challenger["mean_tree_count"]
    if trees:
        return trees > 0
    return place[challenger["config_id"]] < place[incumbent["config_id"]]


def staged_sweep(
    start: Any,
    stages: Sequence[tuple[str, Sequence[Any]]],
    folds: Sequence[str],
    evaluate: Callable[[Any, str], float],
) -> list[dict[str, Any]]:
    """Vary one field of the incumbent per stage and keep the best mean.

    ``evaluate`` runs one Spark job per configuration and fold and returns a metric;
    ties keep the earlier configuration.
    """
    history: list[dict[str, Any]] = []
    incumbent = start
    for name, values in stages:
        options = [replace(incumbent, **{name: value}) for value in values]
        scored = []
        for config in options:
            results = [evaluate(config, fold) for fold in folds]
            mean = math.fsum(results) / len(results)
            scored.append(mean)
            history.append(
                {"stage": name, "value": str(getattr(config, name)), "mean": mean, "chosen": False}
            )
        winner = max(range(len(options)), key=lambda i: (scored[i], -i))
        history[len(history) - len(options) + winner]["chosen"] = True
        incumbent = options[winner]
    return history


def compare_with_baseline(selected: DataFrame, baseline: DataFrame) -> DataFrame:
    """Selected minus stored metrics; both have one row."""
    names = [ALL_TARGETS, LABELED, "final_hits"]
    left = selected.select(*[F.col(n).alias(f"s_{n}") for n in names])
    right = baseline.select(*[F.col(n).alias(f"b_{n}") for n in names])
    return attach_row(left, right).select(
        *[F.col(f"b_{n}").alias(f"baseline_{n}") for n in names],
        *[(F.col(f"s_{n}") - F.col(f"b_{n}")).alias(f"selected_minus_baseline_{n}") for n in names],
    )


def verify_metrics(stored: DataFrame, recomputed: DataFrame, ulps: int = 32) -> DataFrame:
    """Stored against recomputed metrics: counts exact, ratios within some ulps.

    The spacing of doubles near a value in (2**(e-1), 2**e] is at most 2**(e-53).
    """
    counts = ["final_hits", "target_users", "labeled_users"]
    ratios = [ALL_TARGETS, LABELED]
    left = stored.select(*[F.col(n).alias(f"s_{n}") for n in counts + ratios])
    right = recomputed.select(*[F.col(n).alias(f"r_{n}") for n in counts + ratios])
    checks = [(F.col(f"s_{n}") == F.col(f"r_{n}")).alias(f"{n}_equal") for n in counts]
    for name in ratios:
        exact = F.col(f"r_{name}")
        exponent = F.floor(F.log2(F.greatest(F.abs(exact), F.lit(1e-300))))
        tolerance = F.lit(float(ulps)) * F.pow(F.lit(2.0), exponent - 52)
        checks.append((F.abs(F.col(f"s_{name}") - exact) <= tolerance).alias(f"{name}_close"))
    return attach_row(left, right).select(*checks)
