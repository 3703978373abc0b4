"""Groups of texts that nearly reach the similarity, and the bounds that keep them apart."""

import random

import numpy as np
from pyspark.sql import functions as F

from morrow.llm import near_dedup


def _near_misses(count, words=150, edits=3, seed=5):
    """Copies of one text, each with words of its own at scattered places; width 4: 0.72 alike."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for n in range(count):
        text = list(base)
        for place in rng.sample(range(4, words - 4, 4), edits):
            text[place] = f"own{n}x{place}"
        texts.append(" ".join(text))
    return texts


def _count_estimated(monkeypatch):
    formed, old = [], near_dedup.estimated

    def counted(pairs, regs, similarity):
        formed.append(pairs.count())
        return old(pairs, regs, similarity)

    monkeypatch.setattr(near_dedup, "estimated", counted)
    return formed


def test_near_misses_form_few_pairs(spark, monkeypatch):
    """With sketches alone, 5972 of the 7140 pairs were formed in the last round."""
    formed = _count_estimated(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(_near_misses(120))), "doc_id long, text string")
    assert near_dedup.near_digest(docs, 4, 80).count() == 120
    assert max(formed) < 1000


def test_links_of_a_group_equal_brute_force(spark):
    texts = [t for e in (0, 1, 2, 3) for t in _near_misses(25, words=90, edits=e, seed=e)]
    sets = [near_dedup.word_shingles(near_dedup.text_words(t), 4) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        old = list(low)
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if low == old:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_digest(docs, 4, 80).collect()}
    assert found == dict(enumerate(low))


def test_parities_never_rule_out_a_link(spark):
    rng, pairs = np.random.default_rng(3), []
    for size in (1, 2, 5, 9, 45, 150, 900, 5000):
        for _ in range(40):
            whole = rng.integers(0, 2**64, size + size // 2, dtype=np.uint64)
            left, right = whole[:size], whole[rng.integers(0, size // 2 + 1) :]
            right = right[: max(1, size - int(rng.integers(0, size // 2 + 1)))]
            common = len(np.intersect1d(left, right))
            linked = 100 * common >= 80 * (len(left) + len(right) - common)
            pairs.append((near_dedup.parities(left).tolist(), near_dedup.parities(right).tolist(),
                          len(left), len(right), bool(linked)))
    table = spark.createDataFrame(pairs, "a array<long>, b array<long>, m long, n long, linked boolean")
    passed = near_dedup.similar_parities(F.col("a"), F.col("b"), F.col("m"), F.col("n"), 80)
    counts = {(r["linked"], r["passed"]): r["count"] for r in table.select("linked", passed.alias("passed")).groupBy("linked", "passed").count().collect()}
    assert counts[True, True] > 50 and counts[False, False] > 50
    assert (True, False) not in counts


def test_nodes_without_enough_shared_shingles_drop_out(spark):
    """Node 3 shares half of its shingles; without it, node 4 shares too few as well."""
    sets = {
        1: [*range(10)], 2: [*range(8), 90, 91], 3: [*range(2), 20, 21, 22, *range(30, 35)], 4: [*range(7), 20, 21, 22],
    }
    hashes = spark.createDataFrame(list(sets.items()), "node long, hashes array<long>")
    once = near_dedup.within_reach(hashes, 80, rounds=1).collect()
    assert sorted(map(tuple, once)) == [(1, 8), (2, 8), (4, 10)]
    twice = near_dedup.within_reach(hashes, 80, rounds=2).collect()
    assert sorted(map(tuple, twice)) == [(1, 8), (2, 8)]
