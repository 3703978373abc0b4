"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are packed into shards.  A shard holds, for each dimension, its vectors sorted by
that component; a query walks all lists from their favourable ends at once, scores what it
meets in full, and stops as soon as the threshold (the best score that an unmet vector
could have) is below its k-th best.  The k best of each shard are merged per query.

Queries travel in blocks, one copy of a block per shard; both grow with the input, so the
number of copies is (queries / query block) x (vectors / shard).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.llm.support import stored

_EXACT = 1 << 53


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``floor(scale * x)`` of each component; rows with null or non-finite parts go."""
    parts = F.col("embedding").cast("array<double>")
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(parts, lambda x: F.floor(x * scale).cast("double")).alias("parts"),
        F.size("embedding").alias("n_parts"),
    )


def pack(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` vectors of equal length, stored with their sorted lists.

    Each task packs its own rows.  ``block`` counts 0, 1, 2, ... within a vector length; it is
    a sum over tasks, of which there is one small row per length.
    """

    def block(part: pd.DataFrame, n: int, local: int) -> pd.DataFrame:
        matrix = np.array(part["parts"].to_list(), dtype=np.float64).reshape(len(part), n)
        lists = np.argsort(matrix, axis=0, kind="stable").T.astype(np.uint32)
        return pd.DataFrame(
            {
                "task": [int(part["task"].iloc[0])],
                "n_parts": [n],
                "local": [local],
                "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                "matrix": [matrix.tobytes()],
                "lists": [np.ascontiguousarray(lists).tobytes()],
            }
        )

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, pd.DataFrame] = {}
        made: dict[int, int] = {}
        for batch in batches:
            for n, part in batch.groupby("n_parts"):
                part = pd.concat([waiting.pop(n), part]) if n in waiting else part
                while len(part) >= size:
                    yield block(part.iloc[:size], n, made.get(n, 0))
                    made[n] = made.get(n, 0) + 1
                    part = part.iloc[size:]
                waiting[n] = part
        for n, part in waiting.items():
            if len(part):
                yield block(part, n, made.get(n, 0))

    schema = "task int, n_parts int, local int, ids binary, matrix binary, lists binary"
    packed = stored(rows.withColumn("task", F.spark_partition_id()).mapInPandas(blocks, schema), name)
    counts = packed.groupBy("n_parts", "task").agg(F.count(F.lit(1)).alias("blocks"))
    earlier = Window.partitionBy("n_parts").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))
    return packed.join(starts, ["n_parts", "task"]).withColumn("block", F.col("start") + F.col("local"))


def threshold_search(
    query: np.ndarray, own: int, ids: np.ndarray, matrix: np.ndarray, lists: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard for one query, ties to the smaller id.

    ``lists[j]`` has the rows of the shard in ascending order of component j.  A vector not met
    yet has in each dimension at best the value that the walk has reached there, so the sum
    of weight x value bounds its score.  The walk ends when that bound is below the k-th
    best: at equality an unmet vector could still win by its id.  Once most of the shard is
    met, the rest is scored without walking on.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    up = query[used] > 0
    met = np.zeros(n, dtype=bool)
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    done, depth = 0, min(n, max(16, k))
    while done < n:
        if not len(used) or 2 * met.sum() > n:
            depth = n
            fresh = np.flatnonzero(~met)
        else:
            now = np.zeros(n, dtype=bool)
            now[lists[used[up], n - depth : n - done].ravel()] = True
            now[lists[used[~up], done:depth].ravel()] = True
            fresh = np.flatnonzero(now & ~met)
        met[fresh] = True
        done = depth
        rows = fresh[ids[fresh] != own]
        best_ids = np.concatenate([best_ids, ids[rows]])
        best = np.concatenate([best, inner_products(matrix[rows], query)])
        if len(best) > k:
            edge = np.partition(best, len(best) - k)[len(best) - k]
            best_ids, best = best_ids[best >= edge], best[best >= edge]
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
        if done < n and len(best) == k:
            ends = lists[used, np.where(up, n - done, done - 1)]
            if best.min() > float(matrix[ends, used] @ query[used]):
                break
        depth = min(n, depth * 4)
    order = np.lexsort((best_ids, -best))
    return best_ids[order], best[order]


def inner_products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the limits of a long beyond it."""
    if not matrix.size or np.abs(matrix).max() * np.abs(query).sum() < _EXACT:
        return (matrix @ query).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in matrix]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], dtype=np.int64)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 4096,
    query_rows: int = 1024,
) -> DataFrame:
    """The k best other vectors of each query by integer inner product.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` marks the queries; candidates are
    all rows with another vec_id.  Returns ``query_id, rank`` (from 1), ``vec_id, score``,
    ordered by score descending, then vec_id.

    Defined cases: vectors that are null or hold null or non-finite components, and rows
    without vec_id, take no part; vectors of different lengths are never compared; fewer
    than k candidates give fewer rows; repeated rows each count; of equal query rows
    one is searched; other columns are ignored; an empty table gives an empty result.
    """
    usable = integer_vectors(vectors, scale)
    queries = integer_vectors(vectors.where(is_query), scale).dropDuplicates(["vec_id", "parts"])
    shards = pack(usable, shard_rows, "shards")
    blocks = pack(queries, query_rows, "queries").select(
        "n_parts", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("matrix").alias("queries")
    )
    n_shards = shards.groupBy("n_parts").agg(F.count(F.lit(1)).alias("n_shards"))
    copies = blocks.join(n_shards, "n_parts").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1))
    )
    pairs = shards.select("n_parts", "block", "ids", "matrix", "lists").join(copies, ["n_parts", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                n = row["n_parts"]
                ids = np.frombuffer(row["ids"], np.int64)
                matrix = np.frombuffer(row["matrix"], np.float64).reshape(len(ids), n)
                lists = np.frombuffer(row["lists"], np.uint32).reshape(n, len(ids))
                own = np.frombuffer(row["query_ids"], np.int64)
                weights = np.frombuffer(row["queries"], np.float64).reshape(len(own), n)
                first = row["query_block"] * query_rows
                found = [
                    (first + q, own[q], i, s)
                    for q in range(len(own))
                    for i, s in zip(*threshold_search(weights[q], own[q], ids, matrix, lists, k), strict=True)
                ]
                cols = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(found), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)],
                    names=["n_parts", "query_no", "query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(search, "n_parts int, query_no long, query_id long, vec_id long, score long")
    best = Window.partitionBy("n_parts", "query_no").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
