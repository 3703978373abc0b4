"""Mixing of sources to target weights by iterative proportional fitting.

The corpus is reduced to cells of (source, language, topic) with their token counts.  Raking
scales the cells in turn so that the token shares of each marginal meet its targets, until
all of them do.  The sample has a budget, a share of the corpus's tokens: factors are held
against it, a cell whose factor exceeds 1 is kept in full and counts as such, and the
others are raked against what remains.  So a tiny cell cannot set the rate of the rest.
The draw is a hash of the document: the same rows give the same sample on every run.

Only sums are gathered, by cell or by value of a marginal, and partial sums are formed
before every shuffle.  The tables that are iterated have one row per cell.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.llm.support import DOCUMENT_COLUMNS, body, stored

MARGINALS = ("source", "lang", "topic")
#: Stands for null in a marginal.
NONE = "\x00"
_WORD = r"[^\x20\x09-\x0D]+"
#: Exponents of the production targets: a marginal's shares are raised to them.
TEMPERATURES = {"source": 0.8, "lang": 0.9, "topic": 0.95}
#: Share of the corpus's tokens that the sample is to hold.
BUDGET = 0.75


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("long")


def text_topic(text: Column, words: Column) -> Column:
    """The kind of text, from its form: a stand-in where no topic is known."""
    symbols = F.regexp_count(text, F.lit(r"[*#$%&!]{2,}"))
    return (
        F.when(text.contains(" | "), "table")
        .when(symbols * 5 >= F.greatest(words, F.lit(1)), "symbols")
        .when(text.rlike(r"@|://"), "contact")
        .when(words < 100, "short")
        .when(words >= 1000, "long")
        .otherwise("prose")
    )


def with_marginals(docs: DataFrame, topic: Column | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, the three marginals, ``tokens`` (words) and the ``draw`` in [0, 1)."""
    unknown = F.xxhash64(body(), F.lit(1))
    draw = F.when(F.col("doc_id").isNull(), unknown).otherwise(F.xxhash64("doc_id", F.lit(1)))
    rows = docs.withColumn("__words", word_count(body()))
    kind = topic if topic is not None else text_topic(body(), F.col("__words"))
    marginal = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return rows.select(
        F.struct(*carry).alias("row"),
        marginal(F.col("source")).alias("source"),
        marginal(F.col("lang")).alias("lang"),
        marginal(kind).alias("topic"),
        F.col("__words").alias("tokens"),
        (F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))).alias("draw"),
    )


def tempered(cells: DataFrame, marginal: str, exponent: float) -> DataFrame:
    """Targets ``value, share`` proportional to a power of the present shares."""
    now = cells.groupBy(F.col(marginal).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raised = now.select("value", F.pow(F.col("tokens").cast("double"), F.lit(exponent)).alias("share"))
    whole = raised.agg(F.sum("share")).first()[0] or 1.0
    return raised.select("value", (F.col("share") / whole).alias("share"))


def _filled(wanted: DataFrame, whole: float) -> DataFrame:
    """Goals as shares of ``whole``: a value that has too few tokens is taken whole, and what
    it lacks goes to the other values in proportion to their shares."""
    level = whole
    while True:
        full = F.col("share") * level >= F.col("tokens")
        held, rest = wanted.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))
        ).first()
        raised = (whole - held) / rest if rest else level
        if raised <= level * (1 + 1e-12):
            return wanted.withColumn("share", F.least("tokens", F.col("share") * level) / whole)
        level = raised


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    tolerance: float = 1e-4,
    max_rounds: int = 30,
    budget: float | None = None,
) -> DataFrame:
    """Add ``factor`` to each cell so that token shares meet the targets of every marginal.

    ``targets`` has a table ``value, share`` for each marginal.  Shares are taken over the values
    that have tokens; a value without target gets the factor 0.  The rounds end when no
    share is further than ``tolerance`` from its target, or after ``max_rounds`` (targets that
    contradict empty cells are then met as nearly as raking comes).

    With a ``budget`` the scaled cells hold that share of all tokens, or as many as the values
    with targets have.  No cell then counts with more tokens than it has: a factor above 1 means the whole
    cell, and a value whose target exceeds its tokens is taken whole.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted, whole = {}, float(total if budget is None else budget * total)
    for name in targets:
        present = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
        found = present.where("tokens > 0").join(targets[name].where("share > 0"), "value")
        scale, there = found.agg(F.sum("share"), F.sum("tokens")).first()
        wanted[name] = stored(
            found.select(F.col("value").alias(name), "tokens", (F.col("share") / (scale or 1.0)).alias("share")), "goals"
        )
        if budget is not None:
            whole = min(whole, there or 0.0)
    cells = stored(cells.withColumn("factor", F.lit(whole / total if total else 1.0)), "cells")
    if not total:
        return cells
    if not whole:
        return cells.withColumn("factor", F.lit(0.0))
    goals = {
        name: (_filled(rows, whole) if budget is not None else rows).select(name, F.col("share").alias("goal"))
        for name, rows in wanted.items()
    }
    capped = F.lit(False) if budget is None else F.col("factor") > 1
    for _ in range(max_rounds):
        gap = F.lit(0.0)
        for name, goal in goals.items():
            sums = cells.groupBy(name).agg(
                F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double").alias("held"),
                F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("factor"))).alias("free"),
            )
            now, aim = F.col("held") + F.col("free"), F.coalesce("goal", F.lit(0.0)) * whole
            # Cells in full take no part in a rise; scaling all alike never falls below a lower goal.
            step = F.when((aim > now) & (F.col("free") > 0), (aim - F.col("held")) / F.col("free")).otherwise(aim / now)
            steps = sums.join(goal, name, "left").select(
                name, F.when(now > 0, step).otherwise(F.lit(1.0)).alias("step"), (F.abs(now - aim) / whole).alias("off")
            )
            cells = cells.join(steps, name).withColumn("factor", F.col("factor") * F.col("step")).drop("step")
            # The cells are read on both sides; one plan over all marginals would double with each of them.
            cells = stored(cells.withColumnRenamed("off", f"off_{name}"), "cells")
            gap = F.greatest(gap, F.col(f"off_{name}"))
        # How far the shares were off before this round's steps.
        worst = cells.agg(F.max(gap)).first()[0]
        cells = cells.drop(*[f"off_{name}" for name in goals])
        if worst <= tolerance:
            break
    return cells


def cell_probabilities(
    weighed: DataFrame, targets: Mapping[str, DataFrame] | None = None, budget: float = BUDGET
) -> DataFrame:
    """``source, lang, topic, probability`` of each cell, rounded to nine decimals."""
    cells = stored(weighed.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {name: tempered(cells, name, power) for name, power in TEMPERATURES.items()}
    raked = rake(cells, targets, budget=budget)
    return stored(raked.select(*MARGINALS, F.round(F.least("factor", F.lit(1.0)), 9).alias("probability")), "mix")


def mix(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    topic: Column | None = None,
    budget: float = BUDGET,
) -> DataFrame:
    """Each document with its sampling probability and whether it is drawn.

    Returns ``doc_id, source, lang, topic, tokens, probability, kept``.  Without ``targets`` the
    shares of each marginal are flattened by ``TEMPERATURES``; without ``topic`` the form of
    the text stands for it.  The drawn documents hold the share ``budget`` of all tokens in expectation.

    Defined cases: null sources, languages and topics are values of their own (``NONE``); a
    null or empty text has no tokens and the probability of its cell (1 at most); rows with
    the same doc_id are drawn together, rows without one by their text; texts are counted
    whole; other columns are ignored; an empty table gives an empty result.
    """
    weighed = stored(with_marginals(docs, topic), "weighed")
    rows = weighed.join(cell_probabilities(weighed, targets, budget), list(MARGINALS))
    return rows.select(
        "row.doc_id", *MARGINALS, "tokens", "probability", (F.col("draw") < F.col("probability")).alias("kept")
    )


def draw_documents(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, budget: float = BUDGET
) -> DataFrame:
    """The drawn documents, with the columns of ``documents``."""
    cells = cell_probabilities(with_marginals(docs), targets, budget)
    rows = with_marginals(docs, carry=DOCUMENT_COLUMNS)
    return rows.join(cells, list(MARGINALS)).where("draw < probability").select("row.*")
