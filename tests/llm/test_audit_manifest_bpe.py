"""Filter audit, Merkle manifest and byte-level BPE against brute force, with odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from morrow.llm import byte_bpe, filter_audit, merkle, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("digest", "mask", "part", "docs", "good", "spread", "labelled_id", "first", "tree", "rank", "hash", "item", "node",
         "block", "path", "position", "task", "n", "root", "ids", "decoded", "kids", "is_good")


def documents(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


ODD = [
    (1, None, None, None, None), (2, "", "", "", 0), (3, "  \n\t", "en", "a", 4), (None, "Copy of ONE", "en", "a", 1),
    (None, "Copy of ONE", "en", "a", 1), (5, "Copy of ONE", "de", "b", 1), (5, "Copy of ONE", "de", "b", 1),
    (7, "Copy of ONE", "en", None, None), (-8, "word " * 300, "en", "é", 1), (9, "a b\n" * 30_000, "en", "z", 120_000),
    (10, " ".join(map(str, range(250))), "fr", "z", 3), (11, "x" * 200_000, "fr", "z", 3), (12, "é😀 don't  stop\n", "fr", "z", 3),
]


def audit_by_hand(rows, labels):
    def fails(i):
        text = rows[i][1] or ""
        words = [w for w in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
        key = lambda r: float("inf") if r[0] is None else r[0]
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": any((r[1] or "") == text and key(r) < key(rows[i]) for r in rows),
        }

    failed, found = [fails(i) for i in range(len(rows))], {}
    parts = {r[2] or "" for r in rows}
    for part in parts:
        mine = [i for i in range(len(rows)) if (rows[i][2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if failed[i][f]}
                left -= gone
                total[f] += len(gone)
                label = lambda i, k: any(d == rows[i][0] and v[k] == 1 for d, *v in labels if d is not None)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(failed[i][f] for i in mine) - len(gone),
                    sum(failed[i][f] and sum(failed[i].values()) == 1 for i in mine),
                    sum(label(i, 0) for i in gone), sum(label(i, 1) for i in gone), f,
                ]
        for key, value in found.items():
            if key[0] == part:
                value[-1] = total[value[-1]]
    return {key: tuple(value) for key, value in found.items()}


def test_filter_audit_by_hand(spark):
    labels = [(5, 1, 0), (5, 0, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (3, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    rows = filter_audit.filter_audit(documents(spark, ODD), table).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    mine = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(rows) == 120 * 5 * 4
    assert mine == audit_by_hand(ODD, labels)
    assert filter_audit.filter_audit(documents(spark, []), table).count() == 0
    no_labels = filter_audit.filter_audit(documents(spark, ODD), table.limit(0)).collect()
    assert sum(r.good_lost + r.toxic_lost for r in no_labels) == 0


def test_audit_of_other_filters(spark):
    rng = np.random.default_rng(3)
    rows = [("p", int(m), int(c), 0, 0) for m, c in enumerate(rng.integers(0, 50, 8))]
    histogram = spark.createDataFrame(rows, "part string, mask int, docs long, good long, toxic long")
    found = filter_audit.audit(histogram, "xyz").collect()
    assert len(found) == 18
    for f in "xyz":
        mine = [r for r in found if r["filter"] == f]
        assert {r.shapley for r in mine} == {sum(r.removed for r in mine)}


def manifest_by_hand(rows):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf(r, text):
        return sha("".join(enc(v) for v in (r[0], r[3], r[2], r[4], text)))

    def tree(hashes):
        """Root and, per leaf, the (left, right) hashes of each level."""
        paths, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for i, place in enumerate(at):
                run = range(place // 3 * 3, min(place // 3 * 3 + 3, len(hashes)))
                paths[i].append(("".join(hashes[j] for j in run if j < place), "".join(hashes[j] for j in run if j > place)))
            hashes = [sha("".join(hashes[j : j + 3])) for j in range(0, len(hashes), 3)]
            at = [place // 3 for place in at]
        return (hashes or [None])[0], paths

    order = lambda v: (v is not None, (v or "").encode())
    sources = sorted({r[3] for r in rows}, key=order)
    members = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: tree([leaf(r, r[1]) for r in members[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    found = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(members[s], trees[s][1], strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            fold = leaf(r, text)
            for left, right in path + top:
                fold = sha(left + fold + right)
            proof = sha("".join(left + right for left, right in path + top))
            found.append((r[0], leaf(r, r[1]), trees[s][0], root, proof, fold, fold == root))
    return sorted(found, key=repr)


@pytest.mark.parametrize("digits", [1, 2, 5])
def test_manifest_by_hand(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, digits))
    rng = random.Random(digits)
    more = [(i, f"t\n{i}", "en", rng.choice(["hot", "hot", f"s{i % 7}"]), i) for i in range(100, 190)]
    rows = ODD + more
    found = merkle.manifest_digest(documents(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == manifest_by_hand(rows)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest_digest(documents(spark, [])).count() == 0
    for rows in (ODD[:1], ODD[3:5], [(4, "a\nb", "en", "a", 3), (6, "a\nb", "en", "b", 3)]):
        found = merkle.manifest_digest(documents(spark, rows)).collect()
        assert sorted((tuple(r) for r in found), key=repr) == manifest_by_hand(rows)


def test_manifest_plan_has_no_join_of_proofs(spark, shuffled):
    docs = shuffled.read.parquet(f"{SF}/documents.parquet")
    plan = merkle.manifest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.parse_ranks(byte_bpe.load_ranks(path))
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op13_against_the_library(spark, library):
    found = {r.doc_id: tuple(r)[1:] for r in queries.op13_byte_bpe(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for doc_id, text in texts:
        ids = library[1].encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[doc_id] == (len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest())


def test_encode_and_decode_odd_rows(spark, library):
    path, encoding = library
    docs = documents(spark, ODD)
    tokens = byte_bpe.encode_texts(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((repr(r.doc_id), byte_bpe.ids_of(r.ids)) for r in tokens) == sorted(
        (repr(r[0]), encoding.encode_ordinary(r[1] or "")) for r in ODD
    )
    frame = spark.createDataFrame([(r.doc_id, r.ids, "x") for r in tokens] + [(77, None, "x")], "doc_id long, ids binary, text string")
    back = byte_bpe.decode_tokens(frame, path).collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in back])) == sorted(map(repr, [(r[0], r[1] or "") for r in ODD] + [(77, "")]))
    empty = documents(spark, [])
    assert byte_bpe.token_digest(empty, path, public_tokenizers.PATTERN).count() == 0
    broken = docs.limit(1).withColumn("text", F.expr("cast(X'61FF62' AS string)"))
    checked = byte_bpe.encode_texts(broken, path, public_tokenizers.PATTERN, check=True).collect()
    assert [r.decoded for r in checked] == ["a�b"]


@pytest.mark.parametrize("alphabet", ["abcdefghij ", "aeiouthnsr", "éüßñ漢字кот😀 ", "0123456789 ", " \n\t", "'sdlvertm ", "!?.,-=_#*"])
def test_transducer_on_random_strings(library, alphabet, monkeypatch):
    encoder = byte_bpe.Encoder(library[1]._mergeable_ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "_TRANSITIONS", 500)  # the table is begun anew many times
    monkeypatch.setattr(byte_bpe, "_PIECES_PER_STEP", 7)
    rng = random.Random(alphabet)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encoder.encode(text) == library[1].encode_ordinary(text)


def test_transducer_on_random_vocabularies():
    rng = random.Random(9)
    for _ in range(40):
        tokens = [bytes([c]) for c in b"abc"]
        while len(tokens) < 20:
            joined = rng.choice(tokens) + rng.choice(tokens)
            if joined not in tokens:
                tokens.append(joined)
        ranks = {token: rank for rank, token in enumerate(tokens)}
        machine = byte_bpe.Transducer(ranks)
        for _ in range(100):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
            plain = [piece] if piece in ranks else machine.merges.merge(piece)
            assert list(machine.encode_piece(piece)) == [ranks[t] for t in plain]


def test_tokens_are_emitted_after_bounded_lookahead(library):
    machine = byte_bpe.Transducer(library[1]._mergeable_ranks)
    machine.encode_piece(b"the quick brown fox" * 2000)
    longest = max(map(len, library[1]._mergeable_ranks))
    assert max(len(due) for *_, dues in machine.states for due in dues) <= longest
    assert len(machine.next) < 2000  # a long piece runs through states already made


def test_stream_decoder_equals_the_usual_replacement():
    decoder = byte_bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    rng = random.Random(1)
    pool = [*"aé漢😀".encode(), 0x80, 0xBF, 0xC0, 0xC1, 0xED, 0xA0, 0xF4, 0x90, 0xF5, 0xFF, 0xE0, 0xF0]
    for _ in range(3000):
        raw = bytes(rng.choice(pool) for _ in range(rng.randrange(12)))
        at = rng.randrange(len(raw) + 1)
        parts = decoder.decode(raw[:at]) + decoder.decode(raw[at:]) + decoder.finish()
        assert parts == raw.decode(errors="replace")


def test_toxicity_broadcasts_no_class_of_this_package(spark):
    model = toxicity.fit([], np.empty(0), np.empty(0, dtype=bool))
    sent = [f for part in model.arrays() for f in (part if isinstance(part, list) else [part])]
    assert {type(f).__module__.split(".")[0] for f in sent} <= {"numpy", "builtins"}
    labels = spark.createDataFrame([(7, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(documents(spark, ODD).withColumn("known_id", F.lit(1)).withColumn("known", F.lit(1)), labels).collect()
    assert len(rows) == len(ODD)
