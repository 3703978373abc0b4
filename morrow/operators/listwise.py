"""Boosted trees with a listwise objective: the softmax over a group's rows.

Rows are binned once and packed by group, so the softmax of a group lies in one row and no
pairs are formed.  A level of a tree is one scan: every task adds its rows' gradients and
curvatures per (node, feature, bin), the partial sums are merged by an aggregation, and the
best split of each node is picked from running sums over bins.  What the driver sees of a
level is one row per node; leaf values come from the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morrow.functions.expressions import total_of
from morrow.functions.ranking import top_rows
from morrow.functions.stages import write_stage

#: Gains that agree to so many digits are ties: the first feature by position wins, then the lowest border.
_GAIN_DIGITS = 9
_CELLS = "node int, feature int, bin int, rows long, gradient double, curvature double"


@dataclass(frozen=True)
class ListwiseConfig:
    trees: int = 20
    depth: int = 4
    step: float = 0.1
    l2: float = 1.0
    min_gain: float = 1e-6
    #: After so many trees the margins are written with the groups instead of walking all trees again.
    refresh: int = 10


@dataclass
class Tree:
    """Splits and leaf values by node; node ``n`` has the children ``2n`` (below the border) and ``2n + 1``."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The last node that each row of bin numbers reaches."""
        nodes = np.ones(len(bins), dtype=np.int64)
        for node, (feature, cut) in sorted(self.splits.items()):
            here = nodes == node
            nodes[here] = 2 * node + (bins[here, feature] >= cut)
        return nodes

    def margins(self, bins: np.ndarray) -> np.ndarray:
        nodes = self.nodes_of(bins)
        table = np.zeros(int(nodes.max(initial=1)) + 1)
        for node, value in self.values.items():
            if node < len(table):
                table[node] = value
        return table[nodes]


@dataclass(frozen=True)
class ListwiseModel:
    features: tuple[str, ...]
    borders: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]
    #: Mean group loss before the first tree and after each but the last.
    losses: tuple[float, ...]

    def truncated(self, trees: int) -> ListwiseModel:
        return ListwiseModel(self.features, self.borders, self.trees[:trees], self.losses[:trees])

    def score(self) -> Column:
        """The margin as one expression over the feature columns; no row leaves the JVM."""
        return total_of([F.lit(0.0), *(self._walk(tree, 1) for tree in self.trees)])

    def _walk(self, tree: Tree, node: int) -> Column:
        if node not in tree.splits:
            return F.lit(float(tree.values[node]))
        feature, cut = tree.splits[node]
        above = comparable(self.features[feature]) >= F.lit(self.borders[feature][cut - 1])
        return F.when(above, self._walk(tree, 2 * node + 1)).otherwise(self._walk(tree, 2 * node))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """The trees as rows: tree, node, feature and border of a split, or the value of a leaf."""
        rows = []
        for number, tree in enumerate(self.trees):
            for node, (feature, cut) in tree.splits.items():
                rows.append((number, node, self.features[feature], float(self.borders[feature][cut - 1]), None))
            rows += [(number, node, None, None, float(value)) for node, value in tree.values.items()]
        return spark.createDataFrame(rows, "tree int, node int, feature string, border double, value double")


def comparable(name: str) -> Column:
    """The feature as a number; null and NaN are below every border."""
    lowest = F.lit(float("-inf"))
    return F.coalesce(F.nanvl(F.col(name).cast("double"), lowest), lowest)


def pack_groups(rows: DataFrame, borders: dict[str, Sequence[float]]) -> DataFrame:
    """One row per group with a positive: labels, bin numbers row after row, and margins of zero.

    A bin number counts the feature's borders that are not above its value.  A group holds at
    most a union cap of rows.
    """
    bins = [
        total_of([F.lit(0), *((comparable(name) >= F.lit(float(b))).cast("int") for b in edges)]).cast("int")
        for name, edges in borders.items()
    ]
    entry = F.struct(F.col("label").cast("double").alias("label"), F.array(*bins).alias("bins"))
    packed = rows.select("group_id", entry.alias("e")).groupBy("group_id").agg(F.collect_list("e").alias("e"))
    return packed.select(
        "group_id",
        F.col("e.label").alias("labels"),
        F.flatten("e.bins").alias("bins"),
        F.transform("e.label", lambda _: F.lit(0.0)).alias("margins"),
    ).filter(F.exists("labels", lambda label: label > 0))


def _unpacked(frame: pd.DataFrame, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, bins, margins of all rows of a frame and where each group begins."""
    sizes = frame["labels"].str.len().to_numpy()
    labels = np.concatenate(frame["labels"].to_numpy()).astype(np.float64)
    bins = np.concatenate(frame["bins"].to_numpy()).astype(np.int64).reshape(-1, features)
    margins = np.concatenate(frame["margins"].to_numpy()).astype(np.float64)
    return labels, bins, margins, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _softmax(margins: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share and log share of each row in its group."""
    shifted = margins - np.repeat(np.maximum.reduceat(margins, starts), sizes)
    logs = shifted - np.repeat(np.log(np.add.reduceat(np.exp(shifted), starts)), sizes)
    return np.exp(logs), logs


def _histogram_of(trees: Sequence[Tree], current: Tree, level: int, shape: tuple[int, int]):
    """Partial sums of one task per (node of the level, feature, bin); node 0 holds the loss."""
    features, bins_count = shape
    first = 1 << level

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros((3, first * features * bins_count))
        loss, groups = 0.0, 0
        for frame in frames:
            if frame.empty:
                continue
            labels, bins, margins, starts = _unpacked(frame, features)
            for tree in trees:
                margins += tree.margins(bins)
            sizes = np.diff(starts, append=len(labels))
            share, logs = _softmax(margins, starts, sizes)
            target = labels / np.repeat(np.add.reduceat(labels, starts), sizes)
            loss -= float(target @ logs)
            groups += len(starts)
            nodes = current.nodes_of(bins) - first
            inside = nodes >= 0  # others ended above this level
            gradient, curvature = (share - target)[inside], (share * (1 - share))[inside]
            for feature in range(features):
                at = (nodes[inside] * features + feature) * bins_count + bins[inside, feature]
                for row, weights in enumerate((None, gradient, curvature)):
                    cells[row] += np.bincount(at, weights, cells.shape[1])
        used = np.flatnonzero(cells[0])
        yield pd.DataFrame(
            {
                "node": np.append(used // (features * bins_count) + first, 0),
                "feature": np.append(used // bins_count % features, 0),
                "bin": np.append(used % bins_count, 0),
                "rows": np.append(cells[0][used], groups).astype(np.int64),
                "gradient": np.append(cells[1][used], loss),
                "curvature": np.append(cells[2][used], 0.0),
            }
        )

    return sums


def histogram(
    groups: DataFrame, trees: Sequence[Tree], current: Tree, level: int, shape: tuple[int, int]
) -> DataFrame:
    """Rows, gradient and curvature per node of a level, feature and bin."""
    parts = groups.select("labels", "bins", "margins").mapInPandas(_histogram_of(trees, current, level, shape), _CELLS)
    return parts.groupBy("node", "feature", "bin").agg(
        *(F.sum(c).alias(c) for c in ("rows", "gradient", "curvature"))
    )


def split_gains(cells: DataFrame, l2: float) -> DataFrame:
    """Every split of every node: rows of ``bin`` and above go to one side; both sides hold rows.

    The gain is what the split adds to ``gradient^2 / (curvature + l2)``, summed over the sides.
    Window partitions hold the bins of one feature in one node.
    """
    by = Window.partitionBy("node", "feature")
    below = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = ("rows", "gradient", "curvature")
    placed = cells.filter("node > 0").select(
        "node", "feature", "bin",
        *(F.sum(c).over(by).alias(c) for c in sums),
        *(F.sum(c).over(below).alias(f"left_{c}") for c in sums),
    ).filter("left_rows > 0")

    def worth(gradient: Column, curvature: Column) -> Column:
        return gradient * gradient / (curvature + F.lit(float(l2)))

    rest = [F.col(c) - F.col(f"left_{c}") for c in ("gradient", "curvature")]
    gain = worth(F.col("left_gradient"), F.col("left_curvature")) + worth(*rest) - worth(F.col("gradient"), F.col("curvature"))
    return placed.withColumn("gain", F.round(gain, _GAIN_DIGITS))


def best_splits(gains: DataFrame, min_gain: float) -> DataFrame:
    """One split per node: the largest gain, then the first feature, then the lowest border."""
    order = [F.desc("gain"), F.asc("feature"), F.asc("bin")]
    return top_rows(gains.filter(F.col("gain") > min_gain), "node", order, 1).drop("rank")


def _add_margins(trees: Sequence[Tree], features: int):
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            _, bins, margins, starts = _unpacked(frame, features)
            for tree in trees:
                margins += tree.margins(bins)
            yield frame.assign(margins=np.split(margins, starts[1:]))

    return add


def fit_listwise_trees(
    rows: DataFrame, borders: dict[str, Sequence[float]], config: ListwiseConfig = ListwiseConfig()
) -> ListwiseModel:
    """Boosted trees on rows (``group_id``, ``label``, features) for given bin borders.

    Each tree descends the mean over groups of ``log sum exp(s) - mean s(positive)`` by one
    Newton step per leaf, ``-step * gradient / (curvature + l2)``.  Features without borders
    are not used.

    Defined cases: groups without a positive are left out; a group of one row has no gradient;
    null and NaN features are in the lowest bin; repeated rows count each; a tree stops where no
    split gains more than ``min_gain``; no group with a positive is an error.
    """
    usable = {name: sorted(edges) for name, edges in borders.items() if len(edges)}
    if not usable:
        raise ValueError("no feature has a border")
    shape = len(usable), max(len(edges) for edges in usable.values()) + 1
    groups = write_stage(pack_groups(rows, usable), "groups")
    trees, losses, walked = [], [], 0
    for _ in range(config.trees):
        tree = Tree()
        for level in range(config.depth):
            cells = write_stage(histogram(groups, trees[walked:], tree, level, shape), "histogram")
            if level == 0:
                total = cells.filter("node = 0").first()
                if total is None or not total["rows"]:
                    raise ValueError("no group has a positive row")
                losses.append(total["gradient"] / total["rows"])
            found = best_splits(split_gains(cells, config.l2), config.min_gain).collect()
            if not found:
                break
            for row in found:
                tree.splits[row["node"]] = row["feature"], row["bin"]
                tree.values.pop(row["node"], None)
                sides = [(row["left_gradient"], row["left_curvature"])]
                sides.append((row["gradient"] - sides[0][0], row["curvature"] - sides[0][1]))
                for side, (gradient, curvature) in enumerate(sides):
                    tree.values[2 * row["node"] + side] = -config.step * gradient / (curvature + config.l2)
        if not tree.splits:
            break
        trees.append(tree)
        if len(trees) - walked >= config.refresh:
            schema = groups.schema
            groups = write_stage(groups.mapInPandas(_add_margins(trees[walked:], shape[0]), schema), "groups")
            walked = len(trees)
    edges = tuple(tuple(float(b) for b in each) for each in usable.values())
    return ListwiseModel(tuple(usable), edges, tuple(trees), tuple(losses))


def group_loss(rows: DataFrame, score: Column) -> DataFrame:
    """Mean over groups with a positive of ``log sum exp(s) - mean s(positive)``, and their number."""
    scored = rows.select("group_id", F.col("label").cast("double").alias("label"), score.alias("s"))
    peak = scored.groupBy("group_id").agg(
        F.max("s").alias("top"), F.sum("label").alias("positives"), F.sum(F.col("label") * F.col("s")).alias("hit")
    )
    sums = scored.join(peak.filter("positives > 0"), "group_id").groupBy("group_id", "top", "positives", "hit").agg(
        F.sum(F.exp(F.col("s") - F.col("top"))).alias("mass")
    )
    loss = F.log("mass") + F.col("top") - F.col("hit") / F.col("positives")
    return sums.agg(F.count(F.lit(1)).alias("groups"), F.avg(loss).alias("group_loss"))
