"""Implicit factors on given confidences, by alternating conjugate-gradient half steps.

A half step solves, for every entity of one side, the normal equations of a weighted least
squares problem in which each pair is wanted with its confidence and every other pair is
unwanted with confidence one.  The part that all entities share is one Gram matrix of the
other side.  The rest is a sum of outer products over the entity's pairs; these are added in
blocks of bounded size, and the blocks of entities with many pairs are merged cell by cell in
an aggregation, so one very popular item is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.functions.stages import write_stage

_SUMS = "entity bigint, matrix array<double>, target array<double>"


@dataclass(frozen=True)
class ConfidenceAlsConfig:
    rank: int = 64
    iterations: int = 15
    regularization: float = 0.01
    #: Conjugate-gradient steps of a half step; as many as the rank solve it exactly.
    steps: int = 3
    seed: int = 42
    #: Pairs whose outer products one call adds.
    block_rows: int = 4096


def first_factors(ids: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """Small reproducible vectors: they depend on the id, the component and the seed only."""
    unit = lambda i: F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    vector = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda i: (unit(i) - 0.5) / float(rank))
    return ids.select(key).distinct().select(key, vector.alias("features"))


def gram_matrix(factors: DataFrame, rank: int) -> np.ndarray:
    """Sum of the outer products of all vectors; a task sends one matrix."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rank, rank))
        for frame in frames:
            if len(frame):
                rows = np.stack(frame["features"].to_numpy()).astype(np.float64)
                total += rows.T @ rows
        yield pd.DataFrame({"cell": np.arange(rank * rank), "value": total.ravel()})

    parts = factors.select("features").mapInPandas(sums, "cell int, value double")
    found = np.zeros(rank * rank)
    for row in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # rank^2 rows
        found[row["cell"]] = row["value"]
    return found.reshape(rank, rank)


def _block_sums(rank: int):
    """Sums of the rows of each (entity, block); the rows come sorted, so a sum is open until the next key."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, matrix, target = None, None, None
        for frame in frames:
            if frame.empty:
                continue
            rows = np.stack(frame["features"].to_numpy()).astype(np.float64)
            weight = frame["confidence"].to_numpy(np.float64)
            keys = frame[["entity", "block"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            done = []
            for start, end in zip(cuts, cuts[1:]):
                key, mine, w = tuple(keys[start]), rows[start:end], weight[start:end]
                if key != at:
                    if at is not None:
                        done.append((at[0], matrix.ravel(), target))
                    at, matrix, target = key, np.zeros((rank, rank)), np.zeros(rank)
                matrix = matrix + (mine * (w - 1.0)[:, None]).T @ mine
                target = target + w @ mine
            yield pd.DataFrame(done, columns=["entity", "matrix", "target"])
        if at is not None:
            yield pd.DataFrame({"entity": [at[0]], "matrix": [matrix.ravel()], "target": [target]})

    return sums


def entity_sums(pairs: DataFrame, factors: DataFrame, rank: int, block_rows: int) -> DataFrame:
    """Per entity the summed ``(confidence - 1) y y'`` and ``confidence y`` over its pairs.

    ``pairs`` are ``entity, other, confidence``; ``factors`` are ``other, features``.
    """
    sizes = pairs.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    # The pairs of an entity are dealt over its blocks by their other side.
    placed = pairs.join(sizes, "entity").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")))
    rows = placed.join(factors, "other").select("entity", "block", "confidence", "features")
    # Most entities have few pairs: one call sums those of a whole partition.
    sorted_rows = rows.repartition("entity", "block").sortWithinPartitions("entity", "block")
    parts = write_stage(sorted_rows.mapInPandas(_block_sums(rank), _SUMS), "blocks")
    cells = parts.select(
        "entity", F.posexplode(F.concat("matrix", "target")).alias("cell", "value")
    ).groupBy("entity", "cell").agg(F.sum("value").alias("value"))
    whole = cells.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("cells"))
    merged = whole.select("entity", F.transform("cells", lambda c: c["value"]).alias("all")).select(
        "entity",
        F.slice("all", 1, rank * rank).alias("matrix"),
        F.slice("all", rank * rank + 1, rank).alias("target"),
    )
    several = sizes.filter("blocks > 1").select("entity")
    # Entities of one block, nearly all, go on as they are.
    single = parts.join(several, "entity", "left_anti")
    return single.unionByName(merged.join(several, "entity", "left_semi"))


def _solve(gram: np.ndarray, regularization: float, steps: int):
    """Conjugate-gradient steps for a batch of entities at once, from their present vectors."""
    rank = len(gram)
    shared = gram + regularization * np.eye(rank)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            matrix = np.stack(frame["matrix"].to_numpy()).reshape(-1, rank, rank) + shared
            target = np.stack(frame["target"].to_numpy())
            x = np.stack(frame["present"].to_numpy()).astype(np.float64)
            rest = target - np.einsum("nij,nj->ni", matrix, x)
            way, size = rest.copy(), np.einsum("ni,ni->n", rest, rest)
            for _ in range(steps):
                pushed = np.einsum("nij,nj->ni", matrix, way)
                slope = np.einsum("ni,ni->n", way, pushed)
                reach = np.divide(size, slope, out=np.zeros_like(size), where=slope > 0)[:, None]
                x, rest = x + reach * way, rest - reach * pushed
                grown = np.einsum("ni,ni->n", rest, rest)
                keep = np.divide(grown, size, out=np.zeros_like(size), where=size > 1e-30)[:, None]
                way, size = rest + keep * way, grown
            yield pd.DataFrame({"entity": frame["entity"].to_numpy(), "features": list(x)})

    return solve


def half_step(
    pairs: DataFrame, side: str, other: str, factors: DataFrame, config: ConfidenceAlsConfig, present: DataFrame | None = None
) -> DataFrame:
    """New vectors (``side``, ``features``) of all entities of one side.

    ``pairs`` have ``side``, ``other`` and ``confidence``; ``factors`` are the other side's
    vectors.  ``present`` are the vectors to start from (zeros where there are none).

    Defined cases: pairs whose other side has no vector are left out, and so is an entity with
    no other pair; a pair listed twice counts twice; confidences below one weaken a pair, as the
    equations say; no pairs give no vectors.
    """
    rank = config.rank
    named = pairs.select(
        F.col(side).cast("bigint").alias("entity"), F.col(other).cast("bigint").alias("other"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    vectors = factors.select(F.col(other).cast("bigint").alias("other"), "features")
    sums = entity_sums(named, vectors, rank, config.block_rows)
    zeros: Column = F.array_repeat(F.lit(0.0), rank)
    if present is None:
        start = sums.withColumn("present", zeros)
    else:
        known = present.select(F.col(side).cast("bigint").alias("entity"), F.col("features").alias("present"))
        start = sums.join(known, "entity", "left").withColumn("present", F.coalesce("present", zeros))
    solved = start.mapInPandas(
        _solve(gram_matrix(factors, rank), config.regularization, config.steps), "entity bigint, features array<double>"
    )
    return solved.select(F.col("entity").cast(pairs.schema[side].dataType).alias(side), "features")


@dataclass(frozen=True)
class ConfidenceFactors:
    user_factors: DataFrame
    item_factors: DataFrame


def fit_confidence_als(pairs: DataFrame, config: ConfidenceAlsConfig = ConfidenceAlsConfig()) -> ConfidenceFactors:
    """Factors of ``user_id, item_id, confidence``; every half step is a stored stage."""
    pairs = write_stage(pairs.select("user_id", "item_id", "confidence"), "confidences")
    items = write_stage(first_factors(pairs, "item_id", config.rank, config.seed), "factors")
    users = None
    for _ in range(config.iterations):
        users = write_stage(half_step(pairs, "user_id", "item_id", items, config, users), "factors")
        items = write_stage(half_step(pairs, "item_id", "user_id", users, config, items), "factors")
    if users is None:
        raise ValueError("iterations must be positive")
    return ConfidenceFactors(users, items)


def objective(pairs: DataFrame, factors: ConfidenceFactors, config: ConfidenceAlsConfig) -> float:
    """The weighted loss over all pairs, listed or not, with its penalty; the other pairs by Gram matrices."""
    users, items = factors.user_factors, factors.item_factors
    listed = pairs.join(users.withColumnRenamed("features", "u"), "user_id").join(
        items.withColumnRenamed("features", "v"), "item_id"
    )
    score = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    c = F.col("confidence").cast("double")
    part = listed.select(F.sum(c * (1 - score) ** 2 - score**2).alias("x")).first()["x"] or 0.0
    grams = [gram_matrix(f, config.rank) for f in (users, items)]
    return part + float((grams[0] * grams[1]).sum()) + config.regularization * float(sum(np.trace(g) for g in grams))
