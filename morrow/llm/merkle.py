"""Merkle manifest of a dataset: one root, and a proof for every row.

Rows are ranked inside their tree (one tree per source) and the rank's base-3 digits become
columns.  Inside blocks of ``3 ** digits`` neighbours the digit columns are grouped away one
after the other, and each step nests the child structs in their parent, so a block ends as
one struct that holds all its hashes.  The blocks' hashes are the leaves of the next, much
smaller round, up to one hash per tree; the trees' hashes form one more tree.  On the way
down a block meets the path above it in an aggregation on its key, and a transform over its
structs with one explode emits the path of every row: no step joins rows with their proofs.

No task holds more than a block: neither a tree's size nor the number of trees is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.functions.ranking import global_rank
from morrow.llm.support import stored

ARITY = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Base-3 digits of a block: 243 rows.
DIGITS = 5
_PATH = "array<struct<left: string, right: string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def rank_leaves(leaves: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) inside ``tree`` by ``doc_id`` (null first), then ``hash``, and the tree's ``n``.

    The rows are sorted by range once; a row's rank is its distance from the first row of its
    tree in its task plus the tree's rows in earlier tasks, so a tree may span any number of
    tasks.
    """
    ordered = stored(
        leaves.orderBy("tree", "doc_id", "hash").withColumn("position", F.monotonically_increasing_id()), "leaves"
    ).withColumn("task", F.shiftright("position", 33))
    shares = ordered.groupBy("task", "tree").agg(F.count(F.lit(1)).alias("rows"), F.min("position").alias("first"))
    by_tree = Window.partitionBy("tree")
    earlier = by_tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        F.col("task").alias("in_task"),
        F.col("tree").alias("of_tree"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(by_tree).alias("n"),
    )
    mine = (F.col("task") == F.col("in_task")) & F.col("tree").eqNullSafe(F.col("of_tree"))
    return ordered.join(shares, mine).select(
        "tree", (F.col("position") + F.col("shift")).alias("rank"), "n", "hash", "item"
    )


def nest_blocks(nodes: DataFrame, digits: int) -> DataFrame:
    """One row per block: ``tree, n, block`` and ``node``, the nested structs of its rows."""
    names = [f"digit_{i}" for i in range(digits)]
    size = ARITY**digits
    digit = [(F.floor(F.col("rank") / ARITY**i) % ARITY).cast("int").alias(name) for i, name in enumerate(names)]
    rows = nodes.select(
        "tree", "n", F.floor(F.col("rank") / size).cast("long").alias("block"), *digit,
        F.struct("hash", "item").alias("node"),
    ).repartition("tree", "block")
    for level, name in enumerate(names):
        # Grouped inside the partitions of (tree, block): nothing is shuffled again.
        rows = rows.groupBy("tree", "n", "block", *names[level + 1 :]).agg(
            F.array_sort(F.collect_list(F.struct(name, "node"))).alias("runs")
        )
        kids = F.transform("runs", lambda run: run["node"])
        hashes = F.transform("runs", lambda run: run["node"]["hash"])
        own = F.when(F.col("n") > ARITY**level, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0])
        rows = rows.withColumn("node", F.struct(own.alias("hash"), kids.alias("kids"))).drop("runs")
    return rows


def block_items(node: Column, n: Column, path: Column, digits: int) -> Column:
    """``(item, path)`` of all rows of a block, whose own path is ``path``."""

    def below(node: Column, path: Column, level: int) -> Column:
        kids = node["kids"]
        hashes = F.transform(kids, lambda kid: kid["hash"])

        def visit(kid: Column, i: Column) -> Column:
            step = F.struct(
                F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
                F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("right"),
            )
            longer = F.when(n > ARITY ** (level - 1), F.concat(F.array(step), path)).otherwise(path)
            if level == 1:
                return F.struct(kid["item"].alias("item"), longer.alias("path"))
            return below(kid, longer, level - 1)

        found = F.transform(kids, visit)
        return found if level == 1 else F.flatten(found)

    return below(node, path, digits)


def climb(nodes: DataFrame, digits: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ``item`` of every node with its ``path``, ``subroot`` and ``root``.

    ``nodes`` are ``tree, rank, n, hash, item``; ``finish`` gets one row per tree (``tree,
    block, hash``) and returns ``tree, block, path, subroot, root``.
    """
    blocks = stored(nest_blocks(nodes, digits), "blocks")
    size = ARITY**digits
    largest = blocks.agg(F.max("n").alias("n")).first()["n"] or 0
    if largest > size:
        item = F.struct("tree", "block").alias("item")
        count = F.ceil(F.col("n") / size).cast("long").alias("n")
        tops = blocks.select("tree", F.col("block").alias("rank"), count, F.col("node.hash").alias("hash"), item)
        above = climb(tops, digits, finish).select("item.*", "path", "subroot", "root")
    else:
        above = finish(blocks.select("tree", "block", F.col("node.hash").alias("hash")))
    # A block row and the row with its path share one key; a group has two rows.
    met = blocks.unionByName(above, allowMissingColumns=True).groupBy("tree", "block").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "subroot", "root"))
    )
    items = block_items(F.col("node"), F.col("n"), F.col("path"), digits)
    return met.select(F.explode(items).alias("found"), "subroot", "root").select(
        "found.item", "found.path", "subroot", "root"
    )


def tree_of_trees(tops: DataFrame, digits: int) -> DataFrame:
    """Paths and root above the trees, which are ordered by name (null first, bytewise)."""
    ranked = global_rank(tops.select("tree", "block", "hash"), [F.asc_nulls_first("tree")], "rank")
    ranked = stored(ranked, "trees")
    item = F.struct("tree", "block", F.col("hash").alias("subroot"))
    nodes = ranked.select(
        F.lit(0).alias("tree"), (F.col("rank") - 1).alias("rank"), F.lit(ranked.count()).alias("n"), "hash", item.alias("item")
    )

    def finish(top: DataFrame) -> DataFrame:
        none = F.array().cast(_PATH).alias("path")
        return top.select("tree", "block", none, F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))

    return climb(nodes, digits, finish).select("item.tree", "item.block", "path", "item.subroot", "root")


def manifest(docs: DataFrame, carried: Mapping[str, Column] | None = None, digits: int = DIGITS) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root``, ``path`` and the ``carried`` columns.

    A leaf is the SHA-256 of the document's five columns.  In each source the leaves ascend by
    doc_id; while several nodes remain, every three consecutive ones are hashed to one (the
    last run may have fewer).  The sources' subroots are joined likewise to ``root``.  ``path``
    lists, from the leaf up, the hashes left and right of the node in its run; ``folded`` and
    ``proof_hash`` read it.  ``carried`` maps names to columns over ``docs`` that travel along.

    Defined cases: a null column is hashed as ``-``, unlike an empty text; null sources form a
    tree of their own, the first; a null doc_id comes first in its source; rows with the same
    source and doc_id are ordered by their leaf, so repeated rows are leaves of their own and
    the root does not depend on the input's order; a lone leaf is its source's subroot and a
    lone subroot is the root; texts of any length are hashed whole; other columns are ignored;
    an empty table gives an empty result.
    """
    carried = carried or {}
    columns = [F.col(c).alias(c) for c in LEAF_COLUMNS]
    rows = docs.select(*columns, leaf_hash(*(F.col(c) for c in LEAF_COLUMNS)).alias("hash"))
    more = [c.alias(name) for name, c in carried.items()]
    item = F.struct("doc_id", F.col("hash").alias("leaf"), *more)
    leaves = rows.select(F.col("source").alias("tree"), "doc_id", "hash", item.alias("item"))
    found = climb(rank_leaves(leaves), digits, lambda tops: tree_of_trees(tops, digits))
    return found.select("item.doc_id", "item.leaf", "subroot", "root", "path", *(f"item.{name}" for name in carried))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of the siblings, level by level from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def tampered_leaf() -> Column:
    """The leaf of a document that lost its line feeds if crc32 of its doc_id is even, else its own ``hash``."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    return F.when(hit, leaf_hash(*changed)).otherwise(F.col("hash"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op12: the manifest, checked against a copy with tampered texts."""
    rows = manifest(docs, {"found": tampered_leaf()})
    again = folded(F.col("path"), F.col("found"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), again.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
