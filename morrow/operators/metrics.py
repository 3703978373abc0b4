"""Precision, recall, oracle, coverage and overlap of candidates and lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.functions.expressions import any_of
from morrow.functions.joins import attach_row, pair_join
from morrow.functions.ranking import nearest_quantiles
from morrow.operators.popularity import list_pairs
from morrow.operators.union import active
from morrow.schemas import PAIR_KEYS

EVALUATION_K = 20
COUNT_QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}

View = Mapping[str, int]  # source -> rank cap; a pair is in the view through any of them


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two counts, zero when the denominator is zero."""
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def hit_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct candidate pairs that are relevant."""
    return truth.select(*PAIR_KEYS).join(
        candidates.select(*PAIR_KEYS), PAIR_KEYS, "left_semi"
    ).distinct()


def per_user_counts(pairs: DataFrame, truth: DataFrame, target_users: DataFrame) -> DataFrame:
    """Candidates, relevant items and hits per target; the counts add up over shards.

    Distinct pairs are marked while they are partitioned by pair, then counted by
    user with partial sums.
    """
    marked = (
        pairs.select(*PAIR_KEYS)
        .distinct()
        .join(truth.select(*PAIR_KEYS, F.lit(1).alias("hit")), PAIR_KEYS, "left")
    )
    counts = marked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("count"), F.count("hit").alias("hits")
    )
    relevant = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    return (
        target_users.select("user_id")
        .join(relevant, "user_id", "left")
        .join(counts, "user_id", "left")
        .select(
            "user_id",
            *[F.coalesce(name, F.lit(0)).alias(name) for name in ("relevant", "count", "hits")],
        )
    )


def precision_from_hits(counts: DataFrame) -> DataFrame:
    """Both precision variants from a row of final_hits, target_users, labeled_users."""
    slots = F.lit(EVALUATION_K)
    return counts.select(
        "final_hits",
        "target_users",
        "labeled_users",
        ratio(F.col("final_hits"), slots * F.col("target_users")).alias(
            "precision_at_20_all_targets"
        ),
        ratio(F.col("final_hits"), slots * F.col("labeled_users")).alias(
            "precision_at_20_labeled_users"
        ),
    )


def precision_at_20(
    recommendations: DataFrame, truth: DataFrame, target_users: DataFrame
) -> DataFrame:
    """Macro precision over all targets and over labeled users.

    The denominator is fixed, so the macro mean is a quotient of integer counts and
    does not depend on the order of summation.
    """
    users = per_user_counts(list_pairs(recommendations), truth, target_users)
    return precision_from_hits(
        users.agg(
            F.coalesce(F.sum("hits"), F.lit(0)).alias("final_hits"),
            F.count(F.lit(1)).alias("target_users"),
            F.count_if(F.col("relevant") > 0).alias("labeled_users"),
        )
    )


def final_hit_count(recommendations: DataFrame, truth: DataFrame) -> DataFrame:
    return hit_pairs(list_pairs(recommendations), truth).agg(
        F.count(F.lit(1)).alias("final_hits")
    )


def _summary() -> list[Column]:
    hits, relevant, count = F.col("hits"), F.col("relevant"), F.col("count")
    labeled = F.count_if(relevant > 0)
    oracle = F.sum(F.least(hits, F.lit(EVALUATION_K)))
    return [
        ratio(F.sum(hits), F.sum(relevant)).alias("candidate_recall"),
        F.coalesce(
            F.avg(F.when(relevant > 0, hits / F.greatest(relevant, F.lit(1)))), F.lit(0.0)
        ).alias("candidate_recall_macro_labeled_users"),
        F.sum(hits).alias("positive_hits"),
        F.sum(count).alias("candidate_pairs"),
        ratio(F.count_if(hits > 0), labeled).alias("candidate_user_hit_rate"),
        ratio(oracle, EVALUATION_K * F.count(F.lit(1))).alias("candidate_oracle_p20_all_targets"),
        ratio(oracle, EVALUATION_K * labeled).alias("candidate_oracle_p20_labeled_users"),
        F.avg((count > 0).cast("double")).alias("coverage"),
        (F.sum(count) / F.count(F.lit(1))).alias("mean_candidate_count"),
    ]


def summarize_counts(users: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Candidate metrics from per-user counts, optionally per view."""
    keys = list(by)
    names = {f"{q}_candidate_count": at for q, at in COUNT_QUANTILES.items()}
    quantiles = nearest_quantiles(users, "count", names, keys)
    if keys:
        return users.groupBy(*keys).agg(*_summary()).join(quantiles, keys)
    return attach_row(users.agg(*_summary()), quantiles)


def candidate_metrics(
    candidates: DataFrame, truth: DataFrame, target_users: DataFrame
) -> DataFrame:
    """Recall, hit rate, oracle precision and count distribution of a candidate set."""
    return summarize_counts(per_user_counts(candidates, truth, target_users))


def view_counts(
    union: DataFrame, truth: DataFrame, target_users: DataFrame, views: Mapping[str, View]
) -> DataFrame:
    """Per user and view: candidates, hits and relevant items.

    All depths and policies come from one pass over the wide union; a view is a
    condition on its rank columns.
    """
    flags = {name: any_of(active(s, cap) for s, cap in caps.items()) for name, caps in views.items()}
    marked = union.join(
        truth.select(*PAIR_KEYS, F.lit(True).alias("__hit")), PAIR_KEYS, "left"
    )
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    aggregates = []
    for name, flag in flags.items():
        aggregates.append(F.count_if(flag).alias(f"{name}__count"))
        aggregates.append(F.count_if(flag & hit).alias(f"{name}__hits"))
    wide = marked.groupBy("user_id").agg(*aggregates)
    relevant = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    users = (
        target_users.select("user_id")
        .join(relevant, "user_id", "left")
        .join(wide, "user_id", "left")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("view"),
                F.coalesce(f"{name}__count", F.lit(0)).alias("count"),
                F.coalesce(f"{name}__hits", F.lit(0)).alias("hits"),
            )
            for name in views
        ]
    )
    return users.select(
        "user_id",
        F.coalesce("relevant", F.lit(0)).alias("relevant"),
        F.explode(rows).alias("row"),
    ).select("user_id", "relevant", "row.view", "row.count", "row.hits")


def depth_views(sources: Sequence[str], depths: Sequence[int]) -> dict[str, View]:
    """One view per source and depth, and one per depth over all sources."""
    views: dict[str, View] = {
        f"{source}_at_{depth}": {source: depth} for source in sources for depth in depths
    }
    for depth in depths:
        views[f"all_sources_at_{depth}"] = {source: depth for source in sources}
    return views


def policy_views(
    fixed: View, first: str, second: str, policies: Mapping[str, tuple[int, int]]
) -> dict[str, View]:
    """Views that mix two sources under different caps on top of the fixed ones."""
    views: dict[str, View] = {}
    for name, (first_cap, second_cap) in policies.items():
        caps = dict(fixed)
        if first_cap:
            caps[first] = first_cap
        if second_cap:
            caps[second] = second_cap
        views[name] = caps
    return views


def view_metrics(
    union: DataFrame, truth: DataFrame, target_users: DataFrame, views: Mapping[str, View]
) -> DataFrame:
    """Metrics of every depth or policy, one row per view."""
    return summarize_counts(view_counts(union, truth, target_users, views), ["view"])


def overlap_counts(
    left: DataFrame, right: DataFrame, truth: DataFrame, target_users: DataFrame
) -> DataFrame:
    """Per user: pairs and hits of two sources and of their intersection."""
    sides = (
        left.select(*PAIR_KEYS, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(*PAIR_KEYS, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*PAIR_KEYS)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    marked = sides.join(truth.select(*PAIR_KEYS, F.lit(1).alias("h")), PAIR_KEYS, "left")
    both, hit = F.col("l") * F.col("r"), F.coalesce("h", F.lit(0))
    sums = {
        "left": F.col("l"),
        "right": F.col("r"),
        "common": both,
        "left_hits": F.col("l") * hit,
        "right_hits": F.col("r") * hit,
        "shared_hits": both * hit,
    }
    counts = marked.groupBy("user_id").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    return (
        target_users.select("user_id")
        .join(counts, "user_id", "left")
        .select("user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in sums])
    )


def overlap_report(users: DataFrame) -> DataFrame:
    """Micro and per-user overlap of two sources from :func:`overlap_counts`.

    Shares are null where they are undefined.
    """
    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom)

    left, right, common = F.sum("left"), F.sum("right"), F.sum("common")
    left_hits, right_hits, shared = F.sum("left_hits"), F.sum("right_hits"), F.sum("shared_hits")
    fractions = {
        "jaccard": F.col("left") + F.col("right") - F.col("common"),
        "share_left_in_right": F.col("left"),
        "share_right_in_left": F.col("right"),
    }
    values = users.select(
        "*", *[share(F.col("common"), bottom).alias(name) for name, bottom in fractions.items()]
    )
    aggregates = [
        left.alias("left_pairs"),
        right.alias("right_pairs"),
        common.alias("intersection_pairs"),
        share(common, left + right - common).alias("micro_jaccard"),
        left_hits.alias("left_positive_hits"),
        right_hits.alias("right_positive_hits"),
        shared.alias("shared_positive_hits"),
        (left_hits - shared).alias("left_only_positive_hits"),
        (right_hits - shared).alias("right_only_positive_hits"),
        share(shared, left_hits).alias("shared_share_of_left_hits"),
        share(shared, right_hits).alias("shared_share_of_right_hits"),
    ]
    for name in fractions:
        aggregates += [
            F.avg(name).alias(f"{name}_mean"),
            F.percentile(name, 0.5).alias(f"{name}_p50"),
            F.count(name).alias(f"{name}_defined_users"),
            F.count_if(F.col(name).isNull()).alias(f"{name}_undefined_users"),
        ]
    report = values.agg(*aggregates)
    for name in fractions:
        defined = values.filter(F.col(name).isNotNull())
        report = attach_row(report, nearest_quantiles(defined, name, {f"{name}_p90": 0.9}))
    return report


def hit_overlap(
    candidates: DataFrame, others: Mapping[str, DataFrame], truth: DataFrame
) -> DataFrame:
    """Hits of a source, shared with and exclusive to each other source and their union.

    All hit sets are subsets of the truth, so one row per relevant pair carries a
    flag per source and a single aggregation gives every count.
    """
    marked = truth.select(*PAIR_KEYS)
    for name, rows in {"main": candidates, **others}.items():
        flag = rows.select(*PAIR_KEYS).distinct().withColumn(f"in_{name}", F.lit(True))
        marked = pair_join(marked, flag, "left").withColumn(
            f"in_{name}", F.coalesce(f"in_{name}", F.lit(False))
        )
    main = F.col("in_main")
    aggregates = [F.count_if(main).alias("hits")]
    for name in others:
        other = F.col(f"in_{name}")
        aggregates += [
            F.count_if(other).alias(f"{name}_hits"),
            F.count_if(main & other).alias(f"overlap_hits_with_{name}"),
            F.count_if(main & ~other).alias(f"exclusive_hits_vs_{name}"),
        ]
    any_other = any_of(F.col(f"in_{name}") for name in others)
    aggregates += [
        F.count_if(main & ~any_other).alias("exclusive_hits_vs_union"),
        F.count_if(any_other).alias("union_hits"),
    ]
    return marked.agg(*aggregates)


def final_hit_contribution(
    recommendations: DataFrame, candidates: DataFrame, baseline_hits: DataFrame, truth: DataFrame
) -> DataFrame:
    """Final hits found in a source, and those no baseline source had."""
    hits = hit_pairs(list_pairs(recommendations), truth)
    source = candidates.select(*PAIR_KEYS).distinct().withColumn("__in", F.lit(True))
    base = baseline_hits.select(*PAIR_KEYS).distinct().withColumn("__base", F.lit(True))
    marked = pair_join(hits, source, "left").join(base, PAIR_KEYS, "left")
    inside = F.col("__in").isNotNull()
    return marked.agg(
        F.count_if(inside).alias("final_hits_present_in_source"),
        F.count_if(inside & F.col("__base").isNull()).alias("final_hits_exclusive_to_source"),
    )


def final_hit_coverage(
    recommendations: DataFrame, sources: Mapping[str, DataFrame], truth: DataFrame
) -> DataFrame:
    """Final hits that each source has among its candidates."""
    marked = hit_pairs(list_pairs(recommendations), truth)
    for name, rows in sources.items():
        flag = rows.select(*PAIR_KEYS).distinct().withColumn(f"__{name}", F.lit(True))
        marked = pair_join(marked, flag, "left")
    return marked.agg(
        F.count(F.lit(1)).alias("final_hits"),
        *[F.count(f"__{name}").alias(f"final_hits_in_{name}") for name in sources],
    )


def incremental_gain(
    baseline: DataFrame, added: DataFrame, truth: DataFrame, target_users: DataFrame
) -> DataFrame:
    """What a new source adds to a baseline: candidates, hits, recall and oracle.

    One row per pair with two flags, then one row per user, then one row.
    """
    users = overlap_counts(baseline, added, truth, target_users)
    relevant = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    joined = users.join(relevant, "user_id", "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(0))
    )
    new_hits = F.col("right_hits") - F.col("shared_hits")
    union_hits = F.col("left_hits") + new_hits
    top = F.lit(EVALUATION_K)
    slots = EVALUATION_K * F.count(F.lit(1))
    return joined.agg(
        F.sum(F.col("right") - F.col("common")).alias("added_unique_candidates"),
        (F.sum(F.col("right") - F.col("common")) / F.count(F.lit(1))).alias(
            "mean_added_unique_candidates"
        ),
        F.sum(new_hits).alias("new_positive_hits"),
        ratio(F.sum("left_hits"), F.sum("relevant")).alias("baseline_recall"),
        ratio(F.sum(union_hits), F.sum("relevant")).alias("union_recall"),
        ratio(F.sum(new_hits), F.sum("relevant")).alias("delta_recall"),
        ratio(
            F.sum(F.least(union_hits, top)) - F.sum(F.least(F.col("left_hits"), top)), slots
        ).alias("oracle_p20_all_targets_gain"),
    )


def list_precision(predicted: str | Column, true: str | Column, k: int) -> Column:
    """Set-based precision at k of two array columns."""
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    true = F.col(true) if isinstance(true, str) else true
    common = F.size(F.array_intersect(F.slice(predicted, 1, k), true))
    return F.greatest(common, F.lit(0)) / F.lit(k)


def logistic_loss(margin: Column, label: Column) -> Column:
    """Loss of one row in a form that cannot overflow."""
    s, y = margin.cast("double"), label.cast("double")
    return F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))) - y * s


def log_loss(scores: DataFrame, margin: str = "ranker_score", label: str = "label") -> DataFrame:
    """Mean logistic loss of raw margins over all rows."""
    loss = logistic_loss(F.col(margin), F.col(label))
    return scores.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(loss).alias("logloss_sum"),
        (F.sum(loss) / F.count(F.lit(1))).alias("full_candidate_logloss"),
    )
