"""Near-duplicate documents by HyperMinHash sketches.

A document's set of word shingles is hashed into ``bands * rows`` buckets.  Of each bucket's
smallest hash the sketch keeps the number of leading zeros and a few mantissa bits; an
empty bucket borrows from the full bucket with the smallest hash of the two.  Registers are banded,
documents that share a band are compared by the share of equal registers, corrected for
chance collisions of the compressed registers, and what may reach the similarity is
verified on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.llm.support import body, documents_like, shared_path, stored

BANDS, ROWS = 50, 5
MANTISSA = 10
_WORDS = 400_000
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the SplitMix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def text_words(text: str) -> list[bytes]:
    """Words between the white space of the contracts, A-Z in lower case."""
    return text.encode(errors="surrogatepass").lower().split()


def word_shingles(words: list[bytes], width: int) -> set[bytes]:
    """The full set: shingles of ``width`` words, or all words as one where there are fewer."""
    if not words:
        return set()
    if len(words) <= width:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class ShingleHasher:
    """64-bit hashes of shingles, with the hashes of words seen before kept."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = text_words(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > _WORDS:
            self.known = {}
        for word in set(words).difference(self.known):
            self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        each = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(each) - self.width + 1)
        total = np.zeros(n, dtype=np.uint64)
        for i in range(min(self.width, len(each))):
            total = mixed(total + np.uint64(i + 1) + each[i : i + n])
        return np.unique(total)


def borrow_order(buckets: int) -> np.ndarray:
    """For each bucket, the rank of every lender by a hash of (bucket, lender)."""
    pairs = mixed(mixed(np.arange(buckets * buckets, dtype=np.uint64) + np.uint64(11))).reshape(buckets, buckets)
    return pairs.argsort(axis=1).argsort(axis=1).astype(np.uint16)


def registers(hashes: np.ndarray, buckets: int, order: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros above ``MANTISSA`` bits of the smallest hash."""
    if not len(hashes):
        return np.zeros(buckets, dtype=np.uint16)
    spread = mixed(hashes)
    place = (spread >> np.uint64(40)) % np.uint64(buckets)
    low = mixed(spread ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)  # 53 bits: exact as a double
    least = np.full(buckets, np.uint64(1) << np.uint64(53), dtype=np.uint64)
    np.minimum.at(least, place.astype(np.int64), low)
    full = least < np.uint64(1) << np.uint64(53)
    _, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    zeros = np.minimum(53 - exponent, 62).astype(np.uint64)
    top = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> top) & np.uint64((1 << MANTISSA) - 1)
    found = (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    empty, lenders = np.flatnonzero(~full), np.flatnonzero(full)
    # One more full bucket changes only the loans that it takes over itself.
    found[empty] = found[lenders[order[np.ix_(empty, lenders)].argmin(axis=1)]]
    return found


SKETCH = (
    "node long, doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>,"
    " registers binary, digest array<long>, parity array<long>"
)
_PARITY_WORDS = 8
_EVEN_BITS = 0x5555555555555555


def low_bits(regs: np.ndarray) -> np.ndarray:
    """Two bits of each register, 32 registers in a word."""
    two = np.zeros(-(-len(regs) // 32) * 32, dtype=np.uint64)
    two[: len(regs)] = regs & np.uint16(3)
    shifts = (np.arange(len(two), dtype=np.uint64) % np.uint64(32)) * np.uint64(2)
    return np.bitwise_or.reduce((two << shifts).reshape(-1, 32), axis=1).astype(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes, whether the set holds an odd number of them."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * _PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar_parities(a: Column, b: Column, a_size: Column, b_size: Column, percent: int) -> Column:
    """Whether two parities leave room for the similarity, as a join condition.

    Each class in which they differ holds a shingle of one set only, so this bound is certain: the sets of
    a link differ in at most ``(100 - percent) / (100 + percent)`` of the sum of their sizes.
    """
    differ = F.lit(0)
    for word in range(_PARITY_WORDS):
        differ = differ + F.bit_count(F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word))))
    return differ * (100 + percent) <= (a_size + b_size) * (100 - percent)


def similar_digests(a: Column, b: Column, a_size: Column, b_size: Column, n: int, similarity: float) -> Column:
    """Whether two digests leave room for the similarity, as a join condition.

    Registers of different hashes agree in two bits by chance in a quarter of all cases; the
    share of equal registers is held against what the similarity would give, with a margin
    of five standard deviations for the number of registers that the smaller set fills.
    """
    unequal = F.lit(0)
    for word in range(-(-n // 32)):
        differ = F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word)))
        folded = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(_EVEN_BITS))
        unequal = unequal + F.bit_count(folded)
    expected = similarity + (1 - similarity) / 4
    filled = n * (1 - F.exp(-F.least(a_size, b_size) / n))
    margin = 5 * F.sqrt(F.lit(expected * (1 - expected)) / filled)
    return 1 - unequal / n >= F.lit(expected) - margin


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One stored sketch per input row; ``node`` numbers the rows."""
    order = borrow_order(bands * rows)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        step = np.arange(bands, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            sizes, keys, band_keys, found, digests, odd = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = hasher(text)
                sizes.append(len(hashes))
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                regs = registers(hashes, bands * rows, order)
                key = step
                for column in regs.reshape(bands, rows).T:
                    key = mixed(key + column.astype(np.uint64) + np.uint64(1))
                band_keys.append(key.astype(np.int64) if len(hashes) else np.empty(0, np.int64))
                found.append(regs.tobytes())
                digests.append(low_bits(regs))
                odd.append(parities(hashes))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("node", "doc_id", "text_key")),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(band_keys, pa.list_(pa.int64())),
                    pa.array(found, pa.binary()),
                    pa.array(digests, pa.list_(pa.int64())),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                names=["node", "doc_id", "text_key", "n_shingles", "set_key", "bands", "registers", "digest", "parity"],
            )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("node"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(body()).alias("text_key"),
        body().alias("text"),
    )
    return stored(numbered.mapInArrow(sketch, SKETCH), "sketches")


def may_reach(
    left: np.ndarray, right: np.ndarray, left_size: int, right_size: int, similarity: float
) -> bool:
    """Whether the registers leave room for the similarity.

    The share of equal registers is freed from the expected chance collisions (of LogLog
    counter and mantissa together) and compared with a margin of six standard deviations;
    these follow the number of registers that the smaller set can fill by itself.
    """
    n, ratio = len(left), left_size / right_size
    chance = 0.17 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    estimate = (np.count_nonzero(left == right) / n - chance) / (1 - chance)
    filled = n * (1 - np.exp(-min(left_size, right_size) / n))
    return estimate + 6 * np.sqrt(similarity * (1 - similarity) / filled) >= similarity


def estimated(pairs: DataFrame, regs: DataFrame, similarity: float) -> DataFrame:
    """Drop the pairs that their registers rule out."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("a_size").to_pylist(), batch.column("b_size").to_pylist(), strict=True)
            held = [
                may_reach(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), m, n, similarity)
                for x, y, (m, n) in zip(
                    batch.column("a_regs").to_pylist(), batch.column("b_regs").to_pylist(), sizes, strict=True
                )
            ]
            yield batch.filter(pa.array(held, pa.bool_())).select(["a", "b"])

    side = lambda s: regs.select(
        F.col("node").alias(s), F.col("n_shingles").alias(f"{s}_size"), F.col("registers").alias(f"{s}_regs")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            held = []
            columns = (batch.column(n).to_pylist() for n in ("a", "a_text", "b_text"))
            for a, a_text, b_text in zip(*columns, strict=True):
                if a != last:
                    last, left = a, word_shingles(text_words(a_text), width)
                right = word_shingles(text_words(b_text), width)
                common = len(left & right)
                held.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.filter(pa.array(held, pa.bool_())).select(["a", "b"])

    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"{s}_text"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(check, "a long, b long")


def shingle_hashes(texts: DataFrame, width: int) -> DataFrame:
    """``node, hashes``: the distinct shingle hashes of each text, stored."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in batches:
            found = [hasher(text).astype(np.int64) for text in batch.column("text").to_pylist()]
            arrays = [batch.column("node"), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "hashes"])

    return stored(texts.select("node", "text").mapInArrow(hashed, "node long, hashes array<long>"), "hashes")


def within_reach(hashes: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """``node, shared``: nodes that may reach the similarity, with their shingles found in other nodes too.

    A node's intersection with any other is at most ``shared``, so a node with fewer than
    ``percent`` of its shingles shared is linked with none of the others.  Without it more shingles of the
    others lie in one node only, hence the rounds.  Shingles are counted by plain aggregation; one that
    very many nodes hold is only a count.
    """
    for step in range(rounds):
        each = hashes.select("node", F.explode("hashes").alias("hash"))
        single = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
        own = single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        shared = hashes.select("node", F.size("hashes").alias("size")).join(own, "node", "left")
        shared = shared.withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
        shared = stored(shared.where(F.col("shared") * 100 >= F.col("size") * percent).select("node", "shared"), "reach")
        if step + 1 < rounds:
            hashes = stored(hashes.join(shared, "node", "left_semi"), "hashes")
    return shared


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is its component's smallest node.

    Large-star and small-star steps: each moves links to smaller neighbours until every
    component is a star.  Only minima are gathered by node, so a node with very many links
    is no bottleneck.  Each round is stored, which also bounds the plan.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    check = lambda e: e.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
    before = check(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = check(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_components(
    docs: DataFrame, width: int = 5, percent: int = 80, stars: int = 2, keyed: bool = False
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent``.

    Returns one row per input row: ``node, doc_id, n_shingles, component`` (a node), and
    ``component_id``, the smallest doc_id reachable; with ``keyed`` also the text's hash,
    ``text_key``, which names the row together with doc_id.

    Documents with the same set are merged first.  Then candidates come from the buckets of
    equal bands.  In the first ``stars`` rounds each member of a bucket meets one pivot only,
    so a large group of copies costs as many comparisons as it has members.  In the last round
    all members of a bucket that are not yet in the same component meet: no link between
    different components is left untested, and pairs inside a component are never formed.

    Bounds inside the join keep pairs that are far from the similarity from being formed: the sizes,
    the parities of the shingle counts in 512 classes (certain) and two bits of each register.
    Before the last round, nodes with too few shingles in common with all other nodes left drop out
    (certain, too).  The full registers and then the full sets decide the rest.

    A link is found if the documents share one of the bands; at similarity 0.8 with 50
    bands of 5 independent registers all are missed with a probability below 1e-8.  Shingles that
    fall in the same bucket raise it for very short texts: about 4e-7 for sets of 4 and 5.

    Defined cases: texts without words (null, empty) have an empty set and are linked with
    nothing; a null doc_id is larger than any other, and a component of such rows alone has a
    null id; repeated doc_ids and rows are documents of their own; whole texts are
    read; other columns are ignored; an empty table gives an empty result.
    """
    sketch = sketches(docs, width)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id"))
    filled = sketch.where("n_shingles > 0")
    classes = stored(filled.groupBy("set_key").agg(F.min("node").alias("class")), "classes")
    reps = filled.join(classes.select(F.col("class").alias("node")), "node", "left_semi")
    rows = reps.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = stored(rows.join(shared, "key", "left_semi"), "buckets")
    met = buckets.select("node").distinct()
    regs = stored(reps.join(met, "node", "left_semi").select("node", "doc_id", "text_key", "n_shingles", "registers", "digest", "parity"), "registers")
    texts = _texts_of(docs, sketch, regs)
    labels = stored(regs.select("node", "digest", "parity", F.col("node").alias("root")), "labels")
    for step in range(stars + 1):
        now = buckets.join(labels, "node")
        mixed_keys = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        now = now.join(mixed_keys, "key", "left_semi")
        columns = ["n_shingles", "root", "digest", "parity"]
        if step < stars:
            turn = F.xxhash64("node", F.lit(step)) if step else F.col("node")
            first = F.struct(turn.alias("turn"), "node", *columns)
            other = now.groupBy("key").agg(F.min(first).alias("p")).select("key", "p.*")
            apart = F.col("a_root") != F.col("b_root")
        else:
            here = texts.join(now.select("node").distinct(), "node", "left_semi")
            now = now.join(within_reach(shingle_hashes(here, width), percent), "node")
            # The smallest partner of a bucket leaves the most room; the rest of the bucket cannot widen it.
            ends = now.groupBy("key").agg(F.min("n_shingles").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            room = (F.col("n_shingles") + F.col("least")) * percent <= F.col("shared") * (100 + percent)
            now = stored(now.join(ends.where("lo < hi").select("key", "least"), "key").where(room).drop("least"), "open")
            other = now
            apart = F.col("a_root") < F.col("b_root")
            columns.append("shared")
        sides = [
            df.select("key", F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
            for s, df in (("a", other), ("b", now))
        ]
        sizes = [F.col(f"{s}_n_shingles") for s in "ab"]
        close = F.least(*sizes) * 100 >= F.greatest(*sizes) * percent
        if step == stars:
            most = F.least("a_shared", "b_shared")
            close = close & ((sizes[0] + sizes[1]) * percent <= most * (100 + percent))
        close = close & similar_parities(F.col("a_parity"), F.col("b_parity"), *sizes, percent)
        alike = similar_digests(F.col("a_digest"), F.col("b_digest"), *sizes, BANDS * ROWS, percent / 100)
        pairs = sides[0].join(sides[1], (sides[0]["key"] == sides[1]["key"]) & apart & close & alike)
        pairs = pairs.select("a", "b").distinct()
        likely = stored(estimated(pairs, regs, percent / 100), "likely")
        links = stored(verified(likely, texts, width, percent), "verified")
        if links.isEmpty():
            continue
        roots = labels.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
        ends = links.join(roots, "a").join(roots.toDF("b", "b_root"), "b")
        moved = components(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        moved = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        labels = stored(
            labels.join(moved, "root", "left").select("node", "digest", "parity", F.coalesce("to", "root").alias("root")), "labels"
        )
    whole = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
        "set_key", F.coalesce("root", "class").alias("component")
    )
    kept = ["text_key"] if keyed else []
    placed = sketch.select("node", "doc_id", "n_shingles", *kept, F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key"))
    placed = placed.join(whole, "set_key", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(low.alias("low")).select("component", F.col("low.doc_id").alias("component_id"))
    return placed.join(names, "component").select("node", "doc_id", "n_shingles", "component", "component_id", *kept)


def _texts_of(docs: DataFrame, sketch: DataFrame, regs: DataFrame) -> DataFrame:
    """The texts of the given nodes, stored; a row is known by doc_id and text hash."""
    often = sketch.groupBy("doc_id", "text_key").agg(F.min("node").alias("one"), F.count(F.lit(1)).alias("n"))
    often = often.where("n > 1").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), F.lit(True).alias("often"))
    same = regs.select("node", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    marked = same.join(
        often.withColumnsRenamed({"own_id": "often_id", "own_key": "often_key"}),
        F.col("own_id").eqNullSafe(F.col("often_id")) & (F.col("own_key") == F.col("often_key")),
        "left",
    )
    rows = docs.select("doc_id", body().alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
    found = stored(found.select("node", "text", F.coalesce("often", F.lit(False)).alias("often")), "texts")
    # Only rows that are repeated as a whole are found several times.
    once = found.where("often").groupBy("node").agg(F.min("text").alias("text"))
    return found.where("not often").select("node", "text").unionByName(once)


def near_digest(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The columns of query op6."""
    return near_components(docs, width, percent).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with the columns of ``documents``.

    The document with the smallest doc_id stays; where rows share it, the first of them.
    """
    found = stored(near_components(docs, width, percent, keyed=True), "components")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node")
    kept = found.groupBy("component").agg(F.min(order).alias("first"))
    kept = kept.select("first.node").join(found.select("node", "doc_id", "text_key"), "node")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    rows = documents_like(docs).withColumn("text_key", F.xxhash64(body()))
    stay = rows.join(
        kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["text_key"] == kept["kept_key"]), "left_semi"
    )
    twice = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        # Rows repeated as a whole are one document here.
        stay = stay.dropDuplicates(["doc_id", "text_key"])
    return documents_like(stay)
