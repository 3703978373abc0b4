"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from morrow.llm import (
    exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, pii, queries, repeats, toxicity, vector_topk,
)
from test_corpus_queries import linked, repeats as brute_repeats

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("digest", "size", "rank", "node", "norm", "score", "kept", "text_key", "root", "topic", "tokens", "length",
         "known", "known_id", "body", "model", "held_out", "predicted")


@pytest.fixture()
def make(spark):
    """Documents from (doc_id, text), with columns whose names the operators use inside."""

    def build(rows, clash=True):
        df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCUMENTS)
        return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df

    return build


ODD = [(1, None), (2, ""), (3, "  \n\t"), (None, "one two three four five six"), (5, "one two three four five six"),
       (5, "one two three four five six"), (6, "word"), (7, "x" * 200_000), (8, "a b " * 30_000)]


def by_id(rows, *names):
    return sorted([tuple(r[n] for n in names) for r in rows], key=repr)


def test_exact_groups(make):
    rows = exact_dedup.exact_groups(make(ODD)).collect()
    assert len(rows) == len(ODD)
    assert by_id([r for r in rows if r.group_size == 3], "doc_id", "keep_id", "kept") == [
        (5, 5, False), (5, 5, True), (None, 5, False),
    ]
    assert by_id([r for r in rows if r.group_size == 2], "doc_id", "keep_id", "kept") == [(1, 1, True), (2, 1, False)]
    assert exact_dedup.exact_groups(make([])).count() == 0


def test_exact_groups_compare_whole_texts_when_digests_collide(make):
    docs = make([(i, f"text {i % 5}") for i in range(20)])
    weak = lambda text: F.lit("same")
    rows = exact_dedup.exact_groups(docs, digest=weak).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, i % 5, 4) for i in range(20)}
    assert sum(r.kept for r in rows) == 5


def test_state_outlives_micro_batches(spark, make):
    docs = make([(i, f"text {i // 2}") for i in range(40)]).repartition(8)
    rows = exact_dedup.exact_groups(docs, files_per_batch=1).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, i // 2 * 2, 2) for i in range(40)}


def test_drop_copies(make):
    kept = exact_dedup.drop_copies(make(ODD))
    assert kept.columns == DOCUMENTS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_runs(make, min_lines):
    rng = random.Random(min_lines)
    docs = {d: "\n".join(rng.choice("abc") for _ in range(rng.randrange(0, 25))) for d in range(30)}
    seen, expected = set(), {}
    for d in sorted(docs):
        lines = docs[d].split("\n")
        gone = set()
        for i in range(len(lines) - min_lines + 1):
            run = tuple(lines[i : i + min_lines])
            if run in seen:
                gone.update(range(i, i + min_lines))
            seen.add(run)
        expected[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    rows = line_dedup.dedup_lines(make(list(docs.items())), min_lines).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == expected


def test_line_edges(make):
    rows = line_dedup.dedup_lines(make(ODD), 1).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (1, 2, 3)} == {1: 0, 2: 1, 3: 0}
    assert sorted(r.n_removed for r in rows if r.doc_id in (5, None)) == [0, 1, 1]
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_repeats_on_a_small_alphabet(make):
    rng = random.Random(5)
    docs = {d: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 80))) for d in range(40)}
    docs[40], docs[41] = "a" * 300, "é" * 50
    rows = repeats.remove_repeats(make(list(docs.items())), length=10, seed=4).collect()
    mine = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert mine == brute_repeats(docs, 10)


def test_repeats_across_segments(make, monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdef ") for _ in range(4000))
    docs = {1: base, 2: base[500:3500] + "tail", 3: base[100:1500] * 2}
    found = [repeats.Segment, repeats._SEGMENT]
    monkeypatch.setattr(repeats, "_SEGMENT", 1000)
    data = np.frombuffer("".join(docs.values()).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in docs.values()])
    parts = list(repeats.segments(data, ends, 100, 56))
    starts = np.concatenate([repeats.expanded(p.low, p.high) for p in parts])
    inside = [i for i in range(len(data)) if any(a <= i and i + 100 <= b for a, b in zip([0, *ends[:-1]], ends))]
    assert found and sorted(starts.tolist()) == inside


def test_repeat_edges(make):
    rows = repeats.remove_repeats(make(ODD), with_bytes=True).collect()
    assert len(rows) == len(ODD)
    left = {r.doc_id: (r.n_bytes, r.n_removed) for r in rows}
    assert left[1] == left[2] == (0, 0) and left[7] == (200_000, 199_999) and left[8][1] == 120_000 - 4
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in rows)
    assert repeats.remove_repeats(make([])).count() == 0


def test_near_components(make):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    docs = {}
    for d in range(60):
        base = random.Random(d // 6).sample(words, 60 + d // 6)
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(words)
        docs[d] = " ".join(base)
    docs[60], docs[61] = "", None
    docs[62] = docs[63] = "one two"
    expected = linked({d: t or "" for d, t in docs.items()}, 4, 80)
    rows = near_dedup.near_components(make(list(docs.items())), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected


def test_near_edges(make):
    rows = near_dedup.near_components(make(ODD), 4, 80).collect()
    assert len(rows) == len(ODD)
    assert by_id([r for r in rows if r.doc_id in (5, None)], "doc_id", "component_id") == [(5, 5), (5, 5), (None, 5)]
    assert sorted(r.doc_id for r in near_dedup.keep_one(make(ODD)).collect()) == [1, 2, 3, 5, 6, 7, 8]
    assert near_dedup.near_components(make([]), 4, 80).count() == 0
    assert near_dedup.keep_one(make([])).count() == 0


def test_register_estimate_is_corrected():
    order = near_dedup.borrow_order(250)
    rng = np.random.default_rng(3)
    one, two = (near_dedup.registers(rng.integers(0, 1 << 63, 5000).astype(np.uint64), 250, order) for _ in range(2))
    assert not near_dedup.may_reach(one, two, 5000, 5000, 0.8)
    assert near_dedup.may_reach(one, one, 5000, 5000, 0.8)


def test_spans(make):
    text = "mail a.b@c.de, ip 10.0.0.255 or 256.1.1.1, card 4111 1111 1111 1111 bad 4111 1111 1111 1112"
    more = " tel +1 (555) 123-4567 iban DE89 3704 0044 0532 0130 00 x@y.z_p@q.rs é +123"
    rows = pii.find_spans(make([(1, text + more), *ODD])).where("doc_id = 1").collect()
    found = [(s.kind, s.value) for r in rows for s in r.spans]
    assert found[:3] == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111")]
    assert ("phone", "+1 (555) 123-4567") in found and ("iban", "DE89 3704 0044 0532 0130 00") in found
    assert ("email", "x@y.z") in found and ("email", "_p@q.rs") in found
    whole = text + more
    assert all(whole[s.start : s.end] == s.value for r in rows for s in r.spans)
    digest = pii.span_digest(make(ODD)).collect()
    assert len(digest) == len(ODD)
    assert {r.base_sha256 for r in digest} == {hashlib.sha256(b"").hexdigest()}
    assert pii.span_digest(make([])).count() == 0


def test_many_spans_in_one_text(make):
    text = " ".join(f"u{i}@h{i}.org" for i in range(3000))
    (row,) = pii.find_spans(make([(1, text)])).collect()
    assert len(row.spans) == 3000 and all(text[s.start : s.end] == s.value for s in row.spans)


def test_long_runs_do_not_stall(make):
    long = "a" * 300_000
    (row,) = pii.span_digest(make([(1, long + " " + "1" * 300_000 + " " + "1." * 100_000)])).collect()
    assert row.n_email == 0


def test_html_edges():
    page = html_text.main_text
    assert page("") == "" and page("just words") == ""
    assert page("<html><body><nav>Menu</nav><p>" + "long text " * 20 + "<p>end.</body>") == ("long text " * 20).strip() + "\nend."
    assert page("<div class='sidebar'>no<div>no</div></div><article><h1>Head</h1><p>a&amp;b  c<br>d<aside>no</aside><p>e") == "Head\na&b c d\ne"
    assert page("<article>yes<div class='ad'>no<p>no</div>too<script>var x='</p>';</script></article><div id=comments><article class=comment>no</article></div>") == "yes\ntoo"
    assert page("<div class='ad'>open <article><p>text</p></article>") == "text"
    assert page("<article><p>cut <b") == "cut"


def test_html_table(spark):
    rows = [(1, "u", None), (None, None, "<article>x</article>"), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert by_id(html_text.extract_text(pages).collect(), "page_id", "text", "n_chars") == [(1, "", 0), (1, "", 0), (None, "x", 1)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_packing_edges(make):
    rows = packing.pack_documents(make(ODD), queries.word_tokenizer(), 64).collect()
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert all(r.offset + r.length <= 64 for r in rows)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    assert packing.pack_documents(make([]), queries.word_tokenizer()).count() == 0


def test_packed_sequences(make):
    docs = make([(1, "hello world"), (2, "good day"), (3, None)])
    (row,) = packing.packed_sequences(docs, queries.word_tokenizer()).collect()
    tokenizer = packing.WordEncoder(queries.word_tokenizer()).tokenizer
    texts = {1: "hello world", 2: "good day", 3: ""}
    for s in row.segments:
        ids = [*tokenizer.encode(texts[s.doc_id], add_special_tokens=False).ids, 1]
        assert row.input_ids[s.offset : s.offset + s.length] == ids


def test_plan_pairs_large_items():
    plan = packing.plan_bins({60: 2, 40: 2, 35: 3, 10: 7}, 100)
    assert sum(b.count for b in plan) == 4
    placed = {}
    for b in plan:
        assert sum(length * n for length, n in b.items) == 100 - b.gap
        assert sum(n for length, n in b.items if length > 33) <= 2
        for length, n in b.items:
            placed[length] = placed.get(length, 0) + n * b.count
    assert placed == {60: 2, 40: 2, 35: 3, 10: 7}


def test_word_encoder_equals_the_tokenizer():
    encoder = packing.WordEncoder(queries.word_tokenizer())
    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", "'s", "́", "é", "1", "<|endoftext|>", "<|EndOfText|>", "#", "ß", "İ", "\x00", "Σ", "😀", "\x1c", "..", "Don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(2000)]
    ids, counts = encoder.encode(texts)
    whole = [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, whole))
    assert ids.tolist() == [i for each in whole for i in each]


def test_toxicity_edges(spark, make):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 160)] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    docs = make([(i, "you vile fool again" if i % 2 else "a calm and kind text") for i in range(100, 160)] + ODD)
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(rows[i].predicted == i % 2 for i in range(100, 160))
    assert rows[2].predicted == 0 and rows[1].score == rows[2].score
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(ODD) + 60 and {r.predicted for r in none} == {0}
    assert toxicity.toxicity(make([]), labels).count() == 0
    assert toxicity.keep_clean(docs, labels).count() == len(ODD) + 30


def test_rake_against_numpy(spark):
    rng = np.random.default_rng(2)
    table = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    goals = [rng.dirichlet(np.ones(n) * 5) for n in table.shape]
    cells = spark.createDataFrame(
        [(f"s{i}", f"l{j}", f"t{k}", int(table[i, j, k])) for i in range(4) for j in range(3) for k in range(2)],
        "source string, lang string, topic string, tokens long",
    )
    targets = {
        name: spark.createDataFrame([(f"{name[0]}{i}", float(x)) for i, x in enumerate(goal)], "value string, share double")
        for name, goal in zip(mixing.MARGINALS, goals, strict=True)
    }
    weights = table.copy()
    for _ in range(200):
        for axis, goal in enumerate(goals):
            other = tuple(a for a in range(3) if a != axis)
            shape = [-1 if a == axis else 1 for a in range(3)]
            weights *= (goal * table.sum() / weights.sum(axis=other)).reshape(shape)
    rows = mixing.rake(cells, targets, tolerance=1e-7, max_rounds=100).collect()
    for r in rows:
        i, j, k = int(r.source[1]), int(r.lang[1]), int(r.topic[1])
        assert abs(r.tokens * r.factor / weights[i, j, k] - 1) < 1e-3


def test_mix_edges(make):
    rows = mixing.mix(make(ODD)).collect()
    assert len(rows) == len(ODD) and {r.source for r in rows} == {mixing.NONE}
    assert all(0 <= r.probability <= 1 for r in rows)
    assert mixing.mix(make([])).count() == 0 and mixing.draw_documents(make([])).count() == 0
    assert mixing.draw_documents(make(ODD)).columns == list(make([], False).columns)


def test_top_k_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(500, [0.0] * 8), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (600, None), (650, [float("nan")] * 8), (700, [None] * 8), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = vector_topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, shard_rows=64, query_rows=3).collect()
    usable = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and i not in (600, 650, 700)}
    expected = set()
    for q, x in usable.items():
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for i, y in usable.items() if i != q and len(y) == len(x))
            expected.update((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected
    assert vector_topk.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_threshold_stops_early():
    matrix = np.zeros((4000, 4))
    matrix[:, 0] = np.arange(4000)
    lists = np.argsort(matrix, axis=0, kind="stable").T
    asked = []
    real = vector_topk.inner_products
    vector_topk.inner_products = lambda m, q: asked.append(len(m)) or real(m, q)
    try:
        ids, scores = vector_topk.threshold_search(np.array([1.0, 0, 0, 0]), -1, np.arange(4000), matrix, lists, 5)
    finally:
        vector_topk.inner_products = real
    assert ids.tolist() == [3999, 3998, 3997, 3996, 3995] and sum(asked) < 100
    assert vector_topk.inner_products(np.array([[2.0**40]]), np.array([2.0**30])).tolist() == [(1 << 63) - 1]


def test_word_encoder_on_letters_that_case_or_composition_splits():
    encoder = packing.WordEncoder(queries.word_tokenizer())
    rng = random.Random(8)
    letters = "abcİƛǅʰक़ͅéſﬁ中 　\x1c\x85.,'Z9<|>"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(600)]
    ids, counts = encoder.encode([*texts, "", "a<|endoftext|>.B.", "\ud800"])
    ends = np.cumsum(counts)
    for text, start, end in zip([*texts, "", "a<|endoftext|>.B.", "?"], ends - counts, ends, strict=True):
        wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[start:end].tolist() == [*wanted, packing.END_ID]


def test_anchor_ranges_are_even():
    text = np.random.default_rng(3).integers(97, 123, 1 << 19).astype(np.uint8).tobytes()
    row = {"shard": 0, "doc_ids": [1], "sizes": [len(text)], "data": zstandard.compress(text)}
    anchors = repeats.Shard(row, 100, 56).anchors()
    sizes = [len(x) // 8 for x in repeats._by_range(64, 0, 0, anchors).column("k1").to_pylist()]
    assert sum(sizes) == len(anchors) and len(sizes) == 64
    assert max(sizes) < 2 * len(anchors) / 64
