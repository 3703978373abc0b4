"""Line deduplication by a suffix array over line-ID sequences.

Documents are sequences of line IDs.  The suffixes that begin at each line are ranked by
distributed prefix doubling: ranks over h lines at positions i and i + h give the rank over
2h lines at i.  Suffixes of the same rank over h lines form an interval of the suffix array
whose longest common prefix is at least h.  A suffix alone in its interval can share no
longer run with another one and leaves the doubling.

An interval with a longer common prefix lies inside one of ``min_lines``.  So the doubling
stops at that depth, where two overlapping ranks cover a depth that is no power of two.
Where shorter runs count too if they hold enough words, every depth up to ``min_lines`` is
visited once, in one ascent, and the words of a run travel with its suffix.  The first
member of each interval stays; the lines that any other member covers are deleted, and
neighbouring or overlapping covers join to maximal runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morrow.llm.mixing import word_count
from morrow.llm.support import body, stored

#: Words of a suffix's first line and of its run: the same at depth 1.
_WORDS = ["first_words", "words"]
_SUFFIX = ["doc_id", "node", "line", *_WORDS]


def numbered_texts(docs: DataFrame) -> DataFrame:
    """The rows with a stored number, so that later stages name the same rows."""
    return stored(
        docs.select("doc_id", body().alias("text"), F.monotonically_increasing_id().alias("node")), "texts"
    )


def _ordered(keys: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank``, which grows with the sort order: a range sort, with gaps between tasks."""
    return stored(keys.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, ranked by the key."""
    often = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    kept = [c for c in _SUFFIX if c in rows.columns]
    return stored(rows.join(_ordered(often, key), key).select(*kept, "rank"), "suffixes")


def _ahead(suffixes: DataFrame, h: int) -> DataFrame:
    """Pair each suffix with the one ``h`` lines further; those without one leave."""
    further = Window.partitionBy("node").orderBy("line").rangeBetween(h, h)
    paired = suffixes.withColumn("next", F.max("rank").over(further))
    if "words" in suffixes.columns:
        paired = paired.withColumn("words", F.col("first_words") + F.max("words").over(further))
    return stored(paired.where("next is not null"), "pairs")


def depths(min_lines: int, every: bool) -> list[int]:
    """The depths from 1 to ``min_lines``: all of them, or each at most twice the last."""
    found = [1]
    while found[-1] < min_lines:
        found.append(min(min_lines, found[-1] + (1 if every else found[-1])))
    return found


def repeated_runs(texts: DataFrame, min_lines: int, every: bool = False) -> dict[int, DataFrame]:
    """By depth, the suffixes that share so many lines with another one.

    Columns ``doc_id, node, line, rank``; with ``every``, all depths up to ``min_lines`` are
    there, with ``words``, the words of the run over that depth.
    """
    line = F.posexplode(F.split("text", "\n", -1)).alias("line", "value")
    words = [word_count(F.col("value")).alias(name) for name in _WORDS if every]
    # 128 bits of two hashes stand for a line.
    lines = texts.select("doc_id", "node", line).select(
        "doc_id", "node", "line", F.xxhash64("value").alias("id"), F.xxhash64("value", F.lit(1), "value").alias("id2"), *words
    )
    found = {1: _repeated(stored(lines, "lines"), ["id", "id2"])}
    steps = depths(min_lines, every)
    for last, depth in zip(steps, steps[1:]):
        found[depth] = _deeper(found[last], depth - last)
    return found


def _deeper(suffixes: DataFrame, step: int) -> DataFrame:
    """From ranks over h lines to ranks over h + step lines, step <= h."""
    pairs = _ahead(suffixes, step).withColumnsRenamed({"rank": "this"})
    return _repeated(pairs, ["this", "next"])


def first_members(suffixes: DataFrame) -> DataFrame:
    """Of each interval, the member that comes first: smallest doc_id (null last), row, line."""
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node", "line")
    return suffixes.groupBy("rank").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("members"))


def later_members(suffixes: DataFrame) -> DataFrame:
    """The members of each interval but the first."""
    first = first_members(suffixes).select(
        "rank", F.col("first.node").alias("first_node"), F.col("first.line").alias("first_line")
    )
    return suffixes.join(first, "rank").where("not (node = first_node and line = first_line)")


def deleted_runs(texts: DataFrame, min_lines: int, long_words: int | None = None) -> DataFrame:
    """Maximal runs of deleted lines: ``node, doc_id, start, stop`` (exclusive), from 0."""
    runs = repeated_runs(texts, min_lines, every=long_words is not None)
    counted = {min_lines: runs[min_lines]}
    if long_words is not None:
        # The members of an interval hold the same words: whole intervals leave here.
        counted |= {d: runs[d].where(F.col("words") > long_words) for d in range(1, min_lines)}
    covers = reduce(
        DataFrame.unionByName,
        [
            later_members(found).select("doc_id", "node", "line", (F.col("line") + depth).alias("end"))
            for depth, found in counted.items()
        ],
    )
    by_line = Window.partitionBy("node").orderBy("line")
    reach = F.max("end").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    marked = covers.withColumn("begins", F.coalesce((F.col("line") > reach).cast("int"), F.lit(1)))
    return (
        marked.withColumn("run", F.sum("begins").over(by_line))
        .groupBy("node", "run")
        .agg(F.min("doc_id").alias("doc_id"), F.min("line").alias("start"), F.max("end").alias("stop"))
        .drop("run")
    )


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, which are sorted and apart."""
    gap = lambda k: (
        F.coalesce(F.get(runs, k - 1)["stop"], F.lit(0)),
        F.coalesce(F.get(runs, k)["start"], F.size(lines)),
    )
    kept = F.transform(
        F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice(lines, gap(k)[0] + 1, gap(k)[1] - gap(k)[0])
    )
    return F.flatten(kept)


def dedup_lines(docs: DataFrame, min_lines: int = 3, long_words: int | None = None) -> DataFrame:
    """Delete later copies of repeated runs of at least ``min_lines`` lines.

    With ``long_words``, later copies of shorter runs go too if they hold more words than that.

    Lines are parted by ``\\n``; a run counts as repeated when the same lines, in the same
    order, also begin at an earlier place: in a document with a smaller doc_id, or
    further up.  Runs are judged on the input, not on what is left.  Returns one row per
    input row: ``doc_id, text`` (the lines left), ``n_lines, n_removed, n_runs``.

    Defined cases: a null or empty text is one empty line; a text whose lines all go
    becomes empty; a null doc_id is larger than any other; repeated doc_ids and rows are
    told apart by the order of reading; texts of any length are read whole; other
    columns are ignored; an empty table gives an empty result.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    texts = numbered_texts(docs)
    runs = deleted_runs(texts, min_lines, long_words)
    of_row = runs.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    lines = F.split("text", "\n", -1)
    # Both sides grow with the corpus: the same join at every size.
    joined = texts.join(of_row.hint("merge"), "node", "left").withColumn("runs", F.coalesce("runs", none))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    return joined.select(
        "doc_id",
        F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(_without(lines, F.col("runs")), "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        removed.alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
    )


def line_digest(docs: DataFrame, min_lines: int = 3, long_words: int | None = None) -> DataFrame:
    """The columns of query op1."""
    return dedup_lines(docs, min_lines, long_words).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256")
    )
