
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from morrow.llm import html_text, line_dedup, mixing, near_dedup

SF = "/root/testdata/sf0.001"
CELLS = "source string, lang string, topic string, tokens long"


@pytest.mark.parametrize("scale", [1, 10_000])
def test_a_lone_source_does_not_set_the_rate(spark, scale):
    rows = [
        (f"s{i}", f"l{j}", f"t{k}", scale * 1000 * (i + 1) * (j + 2) * (k + 1))
        for i in range(6) for j in range(3) for k in range(3)
    ]
    cells = spark.createDataFrame([*rows, ("lone", "l0", "t0", 20)], CELLS)
    found = {(r.source, r.lang, r.topic): r.probability for r in mixing.cell_probabilities(cells).collect()}
    kept = sum(n * found[s, l, t] for s, l, t, n in rows) / sum(r[3] for r in rows)
    assert abs(kept - mixing.BUDGET) < 1e-3
    assert 0.99 < found["lone", "l0", "t0"] <= 1 and min(found.values()) > 0.3


def test_mixing_keeps_its_budget_beside_a_lone_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lone = docs.limit(1).select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit("word " * 20).alias("text"), "lang", F.lit("lone").alias("source"), "n_chars"
    )
    rows = mixing.mix(docs.unionByName(lone)).collect()
    tokens = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens * r.probability for r in rows) / tokens - mixing.BUDGET) < 1e-3
    assert sum(r.kept for r in rows) > 0.65 * len(rows)


def test_values_short_of_their_target_are_taken_whole(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("b", "x", "t", 900), ("c", "x", "t", 1000)], CELLS)
    shares = {
        "source": [("a", 0.4), ("b", 0.3), ("c", 0.3)], "lang": [("x", 1.0)], "topic": [("t", 1.0)],
    }
    targets = {name: spark.createDataFrame(found, "value string, share double") for name, found in shares.items()}
    rows = mixing.cell_probabilities(cells, targets, budget=0.5).collect()
    found = {r.source: r.probability for r in rows}
    assert found["a"] == pytest.approx(1, abs=1e-3)
    assert found["b"] == pytest.approx(0.5, abs=1e-3) and found["c"] == pytest.approx(0.45, abs=1e-3)


@pytest.mark.parametrize("size", [4, 5, 6, 7, 8])
def test_short_texts_share_a_band(size):
    """Sets of ``size`` and ``size + 1`` shingles, one within the other: a similarity of 0.8 or more."""
    bands, rows = near_dedup.BANDS, near_dedup.ROWS
    order = near_dedup.borrow_order(bands * rows)
    rng = np.random.default_rng(size)
    for more in rng.integers(0, 1 << 63, (5000, size + 1)).astype(np.uint64):
        one, two = (near_dedup.registers(h, bands * rows, order).reshape(bands, rows) for h in (more[:-1], more))
        assert (one == two).all(axis=1).any()


def test_short_pages_without_article_keep_their_text():
    page = html_text.main_text
    assert page("<div class=content><p>Short text.</p><p>One more.</p></div>") == "Short text.\nOne more."
    assert page("<html><body><nav>Menu</nav><p>Hi.</p><footer>no</footer></body></html>") == "Hi."
    assert page("<html><body><nav>Menu</nav><ul><li><a href=x>Home</a></li></ul></body></html>") == ""


def test_short_tails_after_adverts_are_kept():
    long = ("long text " * 20).strip()
    for inset in ("<div class=ad><p>a<p>b<p>c<p>d</div>", "<ul>" + "<li><a href=x>link</a></li>" * 4 + "</ul>"):
        assert html_text.main_text(f"<body><p>{long}</p>{inset}<p>The end.</p></body>") == f"{long}\nThe end."
        short = f"<body><p>A short start.</p>{inset}<p>The end.</p></body>"
        assert html_text.main_text(short) == "A short start.\nThe end."


def test_long_runs_of_one_and_two_lines(spark):
    one = " ".join(f"a{i}" for i in range(51))
    two = [" ".join(f"{c}{i}" for i in range(26)) for c in "bc"]
    texts = {1: [one], 2: ["x", one, "y"], 3: [*two, "z"], 4: ["v", *two], 5: ["p", "q"], 6: ["p", "q"], 7: [two[0], "w"], 8: [one]}
    docs = spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "doc_id long, text string")
    rows = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.dedup_lines(docs, 3, long_words=50).collect()}
    gone = {2: ("x\ny", 1, 1), 4: ("v", 2, 1), 8: ("", 1, 1)}
    assert rows == {d: gone.get(d, ("\n".join(t), 0, 0)) for d, t in texts.items()}


def deleted(docs, min_lines, long_words):
    """Line by line: the lines left of each document."""
    seen, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        lines = docs[d].split("\n")
        for i in range(len(lines)):
            for n in range(1, min_lines + 1):
                run = tuple(lines[i : i + n])
                if len(run) == n and (n == min_lines or len(" ".join(run).split()) > long_words):
                    if run in seen:
                        gone[d].update(range(i, i + n))
                    seen.add(run)
    return {d: [x for i, x in enumerate(docs[d].split("\n")) if i not in gone[d]] for d in docs}


@pytest.mark.parametrize("min_lines, long_words", [(1, 2), (2, 3), (4, 4), (5, 9), (4, 0)])
def test_runs_of_every_depth(spark, min_lines, long_words):
    rng = np.random.default_rng(min_lines)
    lines = ["", " ", "a", "b c", "d  e f", "g h i\tj"]
    docs = {d: "\n".join(rng.choice(lines, rng.integers(1, 12))) for d in range(60)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = line_dedup.dedup_lines(table, min_lines, long_words=long_words).collect()
    expected = deleted(docs, min_lines, long_words)
    assert {r.doc_id: r.text for r in rows} == {d: "\n".join(x) for d, x in expected.items()}
    assert {r.doc_id: r.n_lines - r.n_removed for r in rows} == {d: len(x) for d, x in expected.items()}


def test_marked_pages_exactly(spark):
    """Every page's article, references decoded, word for word."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for html_page in pages.values():
        article = html_page.split("<article>")[1].split("</article>")[0]
        assert html_text.main_text(html_page).split() == html.unescape(re.sub(r"<[^>]*>?", " ", article)).split()
