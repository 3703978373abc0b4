"""Exact inner-product retrieval that never meets item blocks which cannot matter.

Items are ranked by norm and cut into blocks, longest vectors first.  By Cauchy-Schwarz no item
of a block scores above the query's norm times the block's largest norm, so once a query's
``k``-th unseen score is higher than that, neither this block nor any later one can change its
result.  Blocks are met in rounds of doubling width; after each round the queries carry their
running ``k``-th score, and only (query block, item block) pairs that some query still needs
are formed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morrow.functions.joins import lookup_join, pair_join
from morrow.functions.ranking import global_rank, top_rows
from morrow.functions.stages import write_stage
from morrow.functions.vectors import norm
from morrow.operators.factors import _block_top
from morrow.schemas import PAIR_KEYS

#: Bounds are widened by this share, far above the rounding of norms and products.
_SLACK = 1e-9


@dataclass(frozen=True)
class Retrieval:
    """The result, and the block pairs that were multiplied (``round, query_block, item_block``)."""

    rows: DataFrame
    met: DataFrame
    query_blocks: int
    item_blocks: int


def norm_blocks(items: DataFrame, block_rows: int) -> DataFrame:
    """``item_id, features, length, item_block``; block 0 has the longest vectors."""
    measured = items.select("item_id", "features", norm("features").alias("length"))
    ranked = global_rank(measured, [F.desc("length"), F.asc("item_id")], "__rank")
    block = F.floor((F.col("__rank") - 1) / block_rows).cast("int")
    return write_stage(ranked.select("item_id", "features", "length", block.alias("item_block")), "item_blocks")


def _met_blocks(
    needs: DataFrame, pairs: DataFrame, queries: DataFrame, placed: DataFrame, seen_in: DataFrame, k: int
) -> DataFrame:
    """Best rows of the needed (user, item block) pairs; ``pairs`` are their (query block, item block) pairs."""
    left = (
        needs.join(queries.select("user_id", "features", "query_block"), "user_id")
        .join(seen_in, ["user_id", "item_block"], "left")
        .select("user_id", "features", "query_block", "item_block", F.coalesce("seen_here", F.lit(0)).alias("seen_here"))
    )
    right = placed.join(pairs, "item_block").select("item_id", "features", "query_block", "item_block")
    schema = T.StructType(
        [queries.schema["user_id"], placed.schema["item_id"], T.StructField("score", T.DoubleType())]
    )
    return (
        left.groupBy("query_block", "item_block")
        .cogroup(right.groupBy("query_block", "item_block"))
        .applyInPandas(_block_top(k), schema)
    )


def retrieve_pruned(
    queries: DataFrame, items: DataFrame, seen: DataFrame, k: int, source: str, *, block_rows: int = 16384
) -> Retrieval:
    """Exact unseen top ``k`` items per query vector; ties go to smaller item ids.

    ``queries`` are ``user_id, features`` (one row per user), ``items`` are ``item_id, features``,
    ``seen`` has the pairs to leave out.

    Defined cases: a query with fewer than ``k`` unseen items gets all of them and meets every
    block; a zero vector scores zero everywhere; seen pairs of unknown users or items are
    ignored; no queries or no items give an empty result.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    placed = norm_blocks(items, block_rows)
    blocks = write_stage(placed.groupBy("item_block").agg(F.max("length").alias("longest")), "blocks")
    query_blocks = max(1, math.ceil(queries.count() / block_rows))
    asked = queries.select(
        "user_id", "features", norm("features").alias("length"),
        F.pmod(F.xxhash64("user_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
    )
    asked = write_stage(asked, "queries")
    hidden = write_stage(
        lookup_join(seen.select(*PAIR_KEYS).distinct(), queries.select("user_id"), "user_id", "left_semi"), "seen"
    )
    seen_in = write_stage(
        lookup_join(hidden, placed.select("item_id", "item_block"), "item_id", "inner")
        .groupBy("user_id", "item_block").agg(F.count(F.lit(1)).alias("seen_here")),
        "seen_blocks",
    )
    n_blocks = blocks.count()
    best, met, first, width = None, None, 0, 1
    while first < n_blocks:
        last = min(first + width, n_blocks)
        bounds = blocks.filter((F.col("item_block") >= first) & (F.col("item_block") < last))
        reach = asked.select("user_id", "length")
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("user_id", F.col("score").alias("kth"))
            reach = reach.join(kth, "user_id", "left")
        else:
            reach = reach.withColumn("kth", F.lit(None).cast("double"))
        wanted = reach.withColumn("item_block", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        bound = F.col("length") * F.col("longest") * (1 + _SLACK)
        needs = wanted.join(bounds, "item_block").filter(F.col("kth").isNull() | (bound >= F.col("kth")))
        needs = write_stage(needs.select("user_id", "item_block"), "needs")
        if needs.isEmpty():
            break  # later blocks are shorter still
        pairs = needs.join(asked.select("user_id", "query_block"), "user_id").select("query_block", "item_block")
        pairs = write_stage(pairs.distinct(), "block_pairs")
        found = _met_blocks(needs, pairs, asked, placed, seen_in, k)
        unseen = pair_join(found, hidden, "left_anti")
        if best is not None:
            unseen = unseen.unionByName(best.drop("rank"))
        best = write_stage(top_rows(unseen, "user_id", [F.desc("score"), F.asc("item_id")], k), "best")
        pairs = pairs.select(F.lit(first).alias("round"), "query_block", "item_block")
        met = pairs if met is None else met.unionByName(pairs)
        first, width = last, width * 2
    if best is None:
        shape = T.StructType([queries.schema["user_id"], items.schema["item_id"]])
        best = spark.createDataFrame([], shape).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
        met = spark.createDataFrame([], "round int, query_block int, item_block int")
    rows = best.select(*PAIR_KEYS, "score", "rank", F.lit(source).alias("source"))
    return Retrieval(rows, met, query_blocks, n_blocks)
