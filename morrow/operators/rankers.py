"""Candidate rankers on Spark ML and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morrow.functions.expressions import total_of
from morrow.functions.joins import pair_join
from morrow.functions.ranking import bounded_rank
from morrow.functions.stages import write_stage
from morrow.operators.metrics import hit_pairs, logistic_loss, precision_from_hits
from morrow.schemas import PAIR_KEYS


def rank_scores(scores: DataFrame, k: int, source: str) -> DataFrame:
    """Best ``k`` scored pairs per user.

    A user has at most a union cap of rows, so the window partition is bounded.
    """
    order = [F.desc("ranker_score"), F.asc("item_id")]
    return (
        bounded_rank(scores, "user_id", order, "rank")
        .filter(F.col("rank") <= k)
        .select(
            *PAIR_KEYS, F.col("ranker_score").alias("score"), "rank", F.lit(source).alias("source")
        )
    )


def restrict_to_pairs(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of the pairs that another ranker may also use."""
    return pair_join(scores, pairs.select(*PAIR_KEYS), "left_semi")


def learn_borders(rows: DataFrame, features: Sequence[str], bins: int) -> DataFrame:
    """Bin borders per feature from the training rows, as a table.

    The approximate percentiles have a relative rank error of 1/10000 and merge
    partial sketches, so a feature is never sorted in one place.  A feature with a
    single value gets no border.
    """
    points = [i / bins for i in range(1, bins)]
    sketched = rows.agg(
        *[
            F.percentile_approx(F.col(n).cast("double"), points, 10_000).alias(f"b_{n}")
            for n in features
        ],
        *[F.min(F.col(n).cast("double")).alias(f"m_{n}") for n in features],
    )
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.filter(F.array_distinct(f"b_{name}"), lambda b: b > F.col(f"m_{name}")).alias("borders"),
        )
        for name in features
    ]
    return sketched.select(F.explode(F.array(*entries)).alias("e")).select(
        "e.feature", "e.borders"
    )


def border_lists(borders: DataFrame) -> dict[str, list[float]]:
    """The border table on the driver: features times bins numbers."""
    return {row["feature"]: sorted(row["borders"]) for row in borders.collect()}


def apply_borders(rows: DataFrame, borders: dict[str, list[float]]) -> DataFrame:
    """Replace features by bin numbers; features without borders are ignored."""
    usable = {name: values for name, values in borders.items() if values}
    edges = [[float("-inf"), *values, float("inf")] for values in usable.values()]
    if not usable:
        raise ValueError("no feature has a border")
    bucketizer = Bucketizer(
        splitsArray=edges, inputCols=list(usable), outputCols=[f"bin_{name}" for name in usable]
    )
    doubles = rows.withColumns({name: F.col(name).cast("double") for name in usable})
    return bucketizer.transform(doubles).drop(*borders)


@dataclass(frozen=True)
class TreeConfig:
    trees: int = 20
    depth: int = 5
    step: float = 0.1
    subsample: float = 1.0
    seed: int = 42
    bins: int = 32


def fit_trees(rows: DataFrame, features: Sequence[str], config: TreeConfig) -> PipelineModel:
    """Boosted trees with weighted logistic loss on labeled training rows."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features")
    trees = GBTClassifier(
        labelCol="label",
        featuresCol="__features",
        weightCol="sample_weight",
        maxIter=config.trees,
        maxDepth=config.depth,
        stepSize=config.step,
        subsamplingRate=config.subsample,
        maxBins=config.bins,
        seed=config.seed,
    )
    return Pipeline(stages=[assembler, trees]).fit(
        rows.withColumn("label", F.col("label").cast("double"))
    )


def predict_trees(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Raw margin of every pair; a row's score does not depend on other rows."""
    scored = model.transform(rows)
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    return scored.select(*rows.columns, margin.alias("ranker_score"))


def _stage(model: PipelineModel) -> GBTClassificationModel:
    return model.stages[-1]


def prefix_scores(
    model: PipelineModel, rows: DataFrame, tree_counts: Sequence[int]
) -> DataFrame:
    """Margins of the first n trees for several n, as columns ``margin_n``.

    Each tree adds one prediction column; a prefix is a weighted sum of them, so all
    tree counts come from one pass.
    """
    trees = _stage(model)
    deepest = max(tree_counts)
    scored = model.stages[0].transform(rows)
    for number, tree in enumerate(trees.trees[:deepest]):
        scored = tree.setPredictionCol(f"__tree_{number}").transform(scored)
    weights = trees.treeWeights

    def margin(count: int) -> Column:
        parts = (
            F.lit(float(weights[i])) * F.col(f"__tree_{i}")
            for i in range(min(count, len(weights)))
        )
        return total_of(parts).alias(f"margin_{count}")

    return scored.select(*rows.columns, *[margin(count) for count in tree_counts])


def truncated_scores(model: PipelineModel, rows: DataFrame, trees: int) -> DataFrame:
    """Scores of the model cut to its first trees."""
    return prefix_scores(model, rows, [trees]).withColumnRenamed(f"margin_{trees}", "ranker_score")


def prefix_curve(
    margins: DataFrame,
    truth: DataFrame,
    target_users: DataFrame,
    tree_counts: Sequence[int],
    k: int = 20,
) -> DataFrame:
    """Hits, precision and logistic loss for each tree count.

    The margins of the tree counts are unfolded into rows, ranked per user and
    count, and reduced together.  The class probability is the sigmoid of twice the
    margin, so the loss uses the doubled margin.
    """
    stored = write_stage(margins, "margins")
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("tree_count"), F.col(f"margin_{n}").alias("ranker_score"))
            for n in tree_counts
        ]
    )
    rows = stored.select(*PAIR_KEYS, "label", F.explode(entries).alias("e")).select(
        *PAIR_KEYS, "label", "e.tree_count", "e.ranker_score"
    )
    order = [F.desc("ranker_score"), F.asc("item_id")]
    top = bounded_rank(rows, ["tree_count", "user_id"], order, "rank").filter(F.col("rank") <= k)
    hits = (
        top.join(truth.select(*PAIR_KEYS), PAIR_KEYS, "left_semi")
        .groupBy("tree_count")
        .agg(F.count(F.lit(1)).alias("final_hits"))
    )
    loss = logistic_loss(2 * F.col("ranker_score"), F.col("label"))
    losses = rows.groupBy("tree_count").agg(
        F.count(F.lit(1)).alias("candidate_rows"), F.avg(loss).alias("full_candidate_logloss")
    )
    counts = (
        losses.join(hits, "tree_count", "left")
        .withColumn("final_hits", F.coalesce("final_hits", F.lit(0)))
        .withColumn("target_users", target_users.agg(F.count(F.lit(1)).alias("n")).scalar())
        .withColumn("labeled_users", truth.agg(F.count_distinct("user_id").alias("n")).scalar())
    )
    precision = precision_from_hits(counts.drop("candidate_rows")).distinct()
    return counts.join(precision, ["final_hits", "target_users", "labeled_users"])


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance per feature, largest first; one row per model feature."""
    values = _stage(model).featureImportances.toArray()
    rows = sorted(zip(features, map(float, values)), key=lambda row: (-row[1], row[0]))
    # The table is as long as the feature list of the fitted model.
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


@dataclass(frozen=True)
class GroupRanker:
    """Linear scorer with standardized features."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    losses: tuple[float, ...]

    def score(self) -> Column:
        return total_of(
            F.lit(w / s) * (F.col(n).cast("double") - F.lit(m))
            for n, m, s, w in zip(self.features, self.means, self.scales, self.weights)
        )


def _softmax_sums(weights: np.ndarray, means: np.ndarray, scales: np.ndarray):
    """Partial loss and gradient of the packed groups of one task, as one row."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, gradient = 0.0, np.zeros(len(weights))
        for frame in frames:
            for labels, flat in zip(frame["labels"], frame["values"]):
                y = np.asarray(labels, dtype=np.float64)
                x = (np.asarray(flat, dtype=np.float64).reshape(len(y), -1) - means) / scales
                score = x @ weights
                score -= score.max()
                log_share = score - np.log(np.exp(score).sum())
                target = y / y.sum()
                loss -= target @ log_share
                gradient += (np.exp(log_share) - target) @ x
        yield pd.DataFrame({"loss": [loss], "gradient": [gradient]})

    return sums


def fit_group_ranker(
    rows: DataFrame,
    features: Sequence[str],
    *,
    iterations: int = 20,
    step: float = 1.0,
) -> GroupRanker:
    """Query-level softmax: raise the score of a group's positives over its others.

    Minimizes the mean over groups of ``log sum exp(s) - mean s(positive)`` for a
    linear score.  The gradient needs each row once, with the softmax of its own
    group, so no pairs of rows are formed.  A group holds at most a union cap of
    rows; each is stored as one packed row, and an iteration is a scan of the stored
    groups that returns one row of sums per task and shuffles nothing.
    """
    names = list(features)
    numbers = F.array(*[F.col(n).cast("double") for n in names])
    packed = (
        rows.groupBy("group_id")
        .agg(F.collect_list(F.struct(F.col("label").cast("double").alias("label"), numbers.alias("x"))).alias("e"))
        .select("group_id", F.col("e.label").alias("labels"), F.flatten("e.x").alias("values"))
        .filter(F.exists("labels", lambda label: label > 0))
    )
    stored = write_stage(packed, "groups")
    moments = rows.agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    ).first()
    groups = stored.count()
    if not groups:
        raise ValueError("no group has a positive row")
    means = np.array([moments[f"m_{n}"] for n in names], dtype=np.float64)
    scales = np.array([moments[f"s_{n}"] or 1.0 for n in names], dtype=np.float64)
    weights, losses = np.zeros(len(names)), []
    for _ in range(iterations):
        parts = stored.select("labels", "values").mapInPandas(
            _softmax_sums(weights, means, scales), "loss double, gradient array<double>"
        )
        total = parts.agg(
            F.sum("loss").alias("loss"),
            *[F.sum(F.get("gradient", F.lit(i))).alias(f"g{i}") for i in range(len(names))],
        ).first()
        losses.append(total["loss"] / groups)
        weights = weights - step * np.array([total[f"g{i}"] for i in range(len(names))]) / groups
    return GroupRanker(
        tuple(names), tuple(means.tolist()), tuple(scales.tolist()), tuple(weights.tolist()), tuple(losses)
    )


def evaluate_scores(
    scores: DataFrame, truth: DataFrame, target_users: DataFrame, k: int = 20
) -> DataFrame:
    """Hits and precision of the top ``k`` scored pairs."""
    hits = hit_pairs(rank_scores(scores, k, "ranker"), truth).agg(
        F.count(F.lit(1)).alias("final_hits")
    )
    counts = hits.withColumn(
        "target_users", target_users.agg(F.count(F.lit(1)).alias("n")).scalar()
    ).withColumn("labeled_users", truth.agg(F.count_distinct("user_id").alias("n")).scalar())
    return precision_from_hits(counts)

