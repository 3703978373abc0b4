"""Which filter removes what: every order of a set of filters, audited from one histogram.

A document enters only as the set of filters it fails (a bit mask), so one aggregation gives
the number of documents, good ones and toxic ones per part and mask.  Removal by a coalition
of filters is a cooperative game: its worth is the number of documents that fail any of its
members.  The Hart-Mas-Colell potential of the game is computed recursively over the
coalitions, smallest first; a filter's Shapley value is the potential of all filters minus
the potential without it, and the steps of an order are differences of worths.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.llm.support import SPACE_RUN, body

FILTERS = "ABCDE"
#: Filter E, the only one that looks at other documents.
_COPY = 1 << FILTERS.index("E")
COUNTS = ("docs", "good", "toxic")


def own_failures(text: Column) -> Column:
    """Bit mask of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n_words, n_chars = F.size(words), F.char_length(text)
    failures = [
        n_words < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n_words,
        100 * (n_chars - F.char_length(F.translate(text, letters, ""))) > 3 * n_chars,
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failures)), F.lit(0))


def labelled(labels: DataFrame) -> DataFrame:
    """One row per labelled document: is any of its labels good, is any toxic."""
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("is_good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("is_toxic"),
    )


def failure_histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per ``part`` (language) and ``mask`` of failed filters, with their labels' counts.

    A text is stood for by its SHA-256.  Copies of one text are first merged per document id,
    then per label and part, so that the last step, which finds the smallest doc_id of a text,
    sees a few rows per text whatever the number of its copies.
    """
    text = body()
    marks = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        own_failures(text).alias("mask"),
    )
    marks = marks.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("docs"))
    # Documents without an id meet no label; they are spread instead of sharing a null key.
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(1 << 20))).otherwise(0)
    known = labelled(labels).withColumn("labelled_spread", F.lit(0).cast("long"))
    rows = marks.withColumn("spread", spread.cast("long")).join(
        known, (F.col("doc_id") == F.col("labelled_id")) & (F.col("spread") == F.col("labelled_spread")), "left"
    )
    key = ["digest", "part", "mask", F.coalesce("is_good", F.lit(0)).alias("good"), F.coalesce("is_toxic", F.lit(0)).alias("toxic")]
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")
    merged = rows.groupBy(*key).agg(
        F.sum("docs").alias("docs"), F.min(F.struct(order.alias("id"), "docs")).alias("first")
    )
    # ``first.docs`` counts the rows of the smallest id of this group; they stay if no group has a smaller one.
    groups = merged.groupBy("digest", "mask").agg(
        F.min("first.id").alias("least"), F.collect_list(F.struct("part", "good", "toxic", "docs", "first")).alias("groups")
    )

    def outcomes(group: Column, least: Column) -> Column:
        stay = F.when(group["first"]["id"] == least, group["first"]["docs"]).otherwise(F.lit(0))
        return F.array(
            F.struct(group["part"], group["good"], group["toxic"], stay.alias("docs"), F.lit(0).alias("copy")),
            F.struct(group["part"], group["good"], group["toxic"], (group["docs"] - stay).alias("docs"), F.lit(_COPY).alias("copy")),
        )

    spread_out = groups.select(
        "mask", F.explode(F.flatten(F.transform("groups", lambda g: outcomes(g, F.col("least"))))).alias("g")
    ).where("g.docs > 0")
    return spread_out.groupBy(F.col("g.part").alias("part"), (F.col("mask") + F.col("g.copy")).alias("mask")).agg(
        F.sum("g.docs").alias("docs"),
        F.sum(F.col("g.docs") * F.col("g.good")).alias("good"),
        F.sum(F.col("g.docs") * F.col("g.toxic")).alias("toxic"),
    )


def potentials(worth: Column, n_filters: int) -> Column:
    """Potentials of all coalitions, times ``n_filters!``, as an array by coalition mask.

    ``n P(S) = v(S) + sum of P(S without i)``; coalitions come in the order of their masks, so
    those without a member are already there.  All values are whole numbers: a potential is a
    sum of dividends over coalition sizes, and the factorial holds every size.
    """
    scale = factorial(n_filters)

    def add(found: Column, coalition: Column) -> Column:
        total = F.get(worth, coalition) * scale
        for i in range(n_filters):
            smaller = F.get(found, coalition - (1 << i))
            total = total + F.when(F.getbit(coalition, F.lit(i)) == 1, smaller).otherwise(F.lit(0))
        return F.concat(found, F.array(F.call_function("div", total, F.bit_count(coalition).cast("long"))))

    coalitions = F.sequence(F.lit(1), F.lit((1 << n_filters) - 1))
    return F.aggregate(coalitions, F.array(F.lit(0).cast("long")), add)


def audit(histogram: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Every step of every order of ``filters``, per part of a failure histogram.

    ``histogram`` has one row per ``part`` and ``mask`` (bit i: fails ``filters[i]``) with the
    counts ``docs, good, toxic``.  Returns ``part, filter_order, step, filter`` and the counts
    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; ``shapley`` is
    the sum of the filter's removals over all orders.

    Defined cases: masks without documents may be absent; a part whose documents fail nothing
    has rows of zeros; an empty histogram gives an empty result.  The number of rows per part
    is ``len(filters)`` times its factorial, whatever the number of documents.
    """
    n = len(filters)
    everything = (1 << n) - 1
    cells = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def worth(count: str) -> Column:
        def hit(coalition: Column) -> Column:
            return F.aggregate(
                "cells", F.lit(0).cast("long"),
                lambda sum_, c: sum_ + F.when(c["mask"].bitwiseAND(coalition) != 0, c[count]).otherwise(F.lit(0)),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(everything)), hit)

    total = F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["docs"])
    games = cells.select("part", total.alias("total"), *(worth(c).alias(c) for c in COUNTS))
    games = games.withColumn("potential", potentials(F.col("docs"), n))
    orders = F.lit(["".join(p) for p in permutations(filters)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = [F.instr("filter_order", f) for f in filters]
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    steps = steps.withColumns({"before": before, "own": own})

    def at(array: str, coalition: Column) -> Column:
        return F.get(F.col(array), coalition)

    def gained(array: str) -> Column:
        return at(array, F.col("before") + F.col("own")) - at(array, F.col("before"))

    def without(array: str) -> Column:
        return at(array, F.lit(everything)) - at(array, F.lit(everything) - F.col("own"))

    return steps.select(
        "part",
        "filter_order",
        "step",
        F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
        (F.col("total") - at("docs", F.col("before") + F.col("own"))).alias("kept"),
        gained("docs").alias("removed"),
        (at("docs", F.col("own")) - gained("docs")).alias("redundant"),
        without("docs").alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        without("potential").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of query op11: filters A to E over whole texts, per language.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 3% capitals A-Z;
    D: any of ``#$%&*|``; E: the text of a smaller doc_id.

    Defined cases: a null text is empty (it fails A, and E like any other text); a null language
    and an empty one are the same part; a null doc_id is larger than any other and meets no
    label; rows with equal doc_id and text are not each other's copies; several labels of a
    document count as one that is good or toxic if any is; labels of unknown documents and
    other columns are ignored; texts of any length are read whole; no documents, no rows.
    """
    return audit(failure_histogram(docs, labels))
