"""Removal of byte strings of a fixed length that also start earlier, in any document.

The corpus is cut into shards of whole documents.  No suffix order, Burrows-Wheeler transform
or common-prefix array is built: strings are compared by hashes.  A shard hashes its
own strings, and hashes of all shards meet step by step, each step telling more of a string
and only for the groups that are still shared:

1. Anchors.  Of the prefixes of ``seed`` bytes in a string, the one with the smallest hash is
   the string's anchor: equal strings have the same anchor at the same offset, so strings
   with different anchors never need to meet.  Shards send each anchor's hash once; anchors
   held by one string alone leave here.
2. Contexts.  The strings of one anchor lie in one stretch of text.  Of equal
   stretches, which have equal hashes, only the first stays, and all others are repeats as
   a whole.
3. Strings.  Only where one anchor has different contexts, the first of equal
   stretches sends the hashes of its strings, and again all but the first are repeats.

In each step a shard sends any value at most once, packed by hash range, and gets back
which of its values are shared or come later.  Hash ranges grow in number with the input; a
value that a third of all documents hold costs one entry per shard.

The shards are a table bucketed by shard number, so texts are shuffled once, when the table
is written, and are not moved by the joins with the answers.

A Burrows-Wheeler merge proper refines the interleave by one symbol of all suffixes per
pass, 100 passes over every byte here; see README for the figures.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morrow.llm.support import body, shared_path, stored

_SEED = 56
_SHARD_BYTES = 1 << 20
_SEGMENT = 1 << 18
_RANGE_BYTES = 32 << 20
_LEAST_RANGES = 64
_FACTOR = 0x9E3779B97F4A7C15 | 1
_POSITION = (1 << 24) - 1
_LAST = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of any substring of a buffer, from prefix sums modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        n = len(data) + 1
        factor = (_FACTOR + 2 * seed) % (1 << 64)
        up, down = self._powers.get(seed, (np.empty(0), np.empty(0)))
        if len(up) < n:
            up, down = (self._power(f, n) for f in (factor, pow(factor, -1, 1 << 64)))
            self._powers[seed] = up, down
        table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
        self.down = down
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(table[data] * up[: n - 1], out=self.sums[1:])

    @staticmethod
    def _power(factor: int, n: int) -> np.ndarray:
        steps = np.full(n, factor, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the leftmost smallest of the ``width`` values from it on lies."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    place = np.arange(len(values), dtype=np.uint64)
    keyed = (values & ~np.uint64(_POSITION)) | place
    fill = -len(keyed) % width
    keyed = np.concatenate([keyed, np.full(fill, (1 << 64) - 1, dtype=np.uint64)]).reshape(-1, width)
    after = np.minimum.accumulate(keyed, axis=1).ravel()
    before = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(before[:n], after[width - 1 : width - 1 + n]) & np.uint64(_POSITION)).astype(np.int64)


class Segment:
    """Anchors of the strings that start in one stretch of a shard.

    ``low`` to ``high`` (inclusive, places in the shard) are the string starts of each anchor;
    ``anchor`` its hash; ``context`` and ``context2`` 64 and 32 bits of its stretch of text.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, base: int, length: int, seed: int):
        part = data[base : base + _SEGMENT + length - 1]
        self.base, self.length = base, length
        self.hash, self.hash2 = RollingHash(part, 1), RollingHash(part, 2)
        seeds = self.hash.windows(seed)
        place = sliding_first_minimum(seeds, length - seed + 1)
        start = base + np.arange(len(place))
        doc = np.searchsorted(ends, start, side="right")
        fits = start + length <= ends[doc] if len(start) else np.empty(0, dtype=bool)
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & fits)
        last = np.flatnonzero(fits & np.append(new[1:] | ~fits[1:], True))
        at = place[first]
        self.low, self.high, self.anchor = first + base, last + base, seeds[at]
        shape = ((at - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64)
        self.context = mixed(self.hash(first, last + length) + shape)
        self.context2 = (self.hash2(first, last + length) >> np.uint64(32)).astype(np.uint32)

    def strings(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        local = start - self.base
        stop = local + self.length
        return self.hash(local, stop), (self.hash2(local, stop) >> np.uint64(32)).astype(np.uint32)


def segments(data: np.ndarray, ends: np.ndarray, length: int, seed: int) -> Iterator[Segment]:
    for base in range(0, max(0, len(data) - length + 1), _SEGMENT):
        yield Segment(data, ends, base, length, seed)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def expanded(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places of the ranges ``low`` to ``high`` (inclusive) in turn."""
    sizes = high - low + 1
    if not len(sizes):
        return np.empty(0, dtype=np.int64)
    return np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)


class Shard:
    """One row of the shard table, with the answers that it has got so far."""

    def __init__(self, row: dict, length: int, seed: int):
        self.number, self.length, self.seed = row["shard"], length, seed
        self.doc_ids, sizes = row["doc_ids"], np.array(row["sizes"], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.data = np.frombuffer(zstandard.decompress(row["data"]) if row["data"] else b"", np.uint8)
        self.order = np.array([_LAST if d is None else d for d in self.doc_ids], dtype=np.int64)
        self.answers = {}
        for name in ("shared", "split", "later", "strings"):
            parts = [np.frombuffer(x, np.uint64) for x in row.get(name) or ()]
            self.answers[name] = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)

    def segments(self) -> Iterator[Segment]:
        return segments(self.data, self.ends, self.length, self.seed)

    def docs_at(self, place: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.ends, place, side="right")]

    def anchors(self) -> np.ndarray:
        """Each anchor's hash, twice if the shard holds it more often."""
        found = [s.anchor for s in self.segments()]
        values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, int))
        return np.repeat(values, np.minimum(counts, 2))

    def shared_parts(self) -> tuple[list[tuple[Segment, np.ndarray]], dict[str, np.ndarray]]:
        """Anchors that are shared, by segment, and all of them together."""
        parts = [(s, np.flatnonzero(among(s.anchor, self.answers["shared"]))) for s in self.segments()]
        names = ("low", "high", "anchor", "context", "context2")
        whole = {n: np.concatenate([getattr(s, n)[i] for s, i in parts]) if parts else np.empty(0, np.uint64) for n in names}
        return parts, whole

    def open_strings(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """String starts that are repeats as seen so far; (hash, hash2, start) of the open ones."""
        parts, whole = self.shared_parts()
        _, once = np.unique(whole["context"], return_index=True)
        first = np.zeros(len(whole["context"]), dtype=bool)
        first[once] = True
        first &= ~among(whole["context"], self.answers["later"])
        repeats = [expanded(whole["low"][~first], whole["high"][~first])]
        ask = first & among(whole["anchor"], self.answers["split"])
        found, at = ([], [], []), 0
        for segment, kept in parts:
            mine = ask[at : at + len(kept)]
            at += len(kept)
            start = expanded(segment.low[kept][mine], segment.high[kept][mine])
            for column, values in zip(found, (*segment.strings(start), start), strict=True):
                column.append(values)
        columns = [np.concatenate(c) if c else np.empty(0, np.uint64) for c in found]
        _, once = np.unique(columns[0], return_index=True)
        again = np.ones(len(columns[0]), dtype=bool)
        again[once] = False
        repeats.append(columns[2][again])
        return np.concatenate(repeats), tuple(c[once] for c in columns)

    def kept(self) -> Iterator[tuple[int | None, int, int, int, bytes]]:
        """(doc_id, bytes, removed bytes, removed runs, what is left) of each document."""
        starts, (_, _, open_starts) = self.open_strings()
        later = open_starts[among(open_starts.astype(np.uint64), self.answers["strings"])]
        marks = np.zeros(len(self.data) + 1, dtype=np.int32)
        for each in (starts, later):
            marks[each.astype(np.int64)] = 1
        sums = np.concatenate([[0], np.cumsum(marks)])[: len(self.data) + 1]
        place = np.arange(len(self.data))
        gone = sums[place + 1] > sums[np.maximum(place + 1 - self.length, 0)] if len(place) else np.empty(0, dtype=bool)
        for doc_id, end, size in zip(self.doc_ids, self.ends, np.diff(self.ends, prepend=0), strict=True):
            mine = gone[end - size : end]
            runs = int(np.count_nonzero(mine[1:] & ~mine[:-1]) + (size > 0 and mine[0]))
            yield doc_id, int(size), int(mine.sum()), runs, self.data[end - size : end][~mine].tobytes()


def shard_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """Shards of about ``_SHARD_BYTES``, bucketed by number; and the number of hash ranges."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            waiting.sort(key=lambda x: (x[0] is None, x[0] or 0))
            packed = zstandard.compress(b"".join(x[1] for x in waiting), 3)
            columns = [(task << 32) + made], [[x[0] for x in waiting]], [[len(x[1]) for x in waiting]], [packed]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "doc_ids", "sizes", "data"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode(errors="surrogatepass")
                waiting.append((doc_id, raw))
                size += len(raw)
                if size >= _SHARD_BYTES:
                    yield shard()
                    made, waiting, size = made + 1, [], 0
        if waiting:
            yield shard()

    packed = texts.mapInArrow(pack, "shard long, doc_ids array<long>, sizes array<int>, data binary")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (128 << 20))
    name = f"shards_{uuid.uuid4().hex}"
    (
        packed.repartition(buckets, "shard")
        .write.bucketBy(buckets, "shard")
        .option("path", shared_path(spark, "shards"))
        .option("compression", "none")
        .saveAsTable(name)
    )
    return spark.table(name), max(_LEAST_RANGES, total // _RANGE_BYTES)


PACKED = "range long, shard long, k1 binary, k2 binary, k3 binary, k4 binary"


def _by_range(ranges: int, first: int, shard: int, key: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per hash range: the entries of ``key`` in it, and the columns along.

    Anchors are the smallest hashes of their strings and crowd in the lowest ranges, so the
    range is that of the key mixed once more.
    """
    where = ((mixed(key) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((key, where))
    where, key, columns = where[order], key[order], [c[order] for c in columns]
    numbers, starts = np.unique(where, return_index=True)
    stops = np.append(starts[1:], len(where))[: len(starts)]
    packs = [[c[a:b].tobytes() for a, b in zip(starts, stops, strict=True)] for c in (key, *columns)]
    packs += [[None] * len(numbers)] * (4 - len(packs))
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers + first), pa.array([shard] * len(numbers), pa.int64()), *(pa.array(p, pa.binary()) for p in packs)],
        names=["range", "shard", "k1", "k2", "k3", "k4"],
    )


def _entries(table: pa.Table, *kinds) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row that each packed entry comes from, and the columns of entries."""
    columns = [
        [np.frombuffer(x, kind) for x in table.column(f"k{i}").to_pylist()] for i, kind in enumerate(kinds, 1)
    ]
    row = np.repeat(np.arange(table.num_rows), [len(x) for x in columns[0]])
    return row, [np.concatenate(c) for c in columns]


def _answer(table: pa.Table, row: np.ndarray, values: np.ndarray, kind: str) -> pa.Table:
    """One row per shard that gets an answer."""
    shards = table.column("shard").to_pylist()
    order = np.argsort(row, kind="stable")
    row, values = row[order], values[order]
    rows, starts = np.unique(row, return_index=True)
    parts = np.split(values.astype(np.uint64), starts[1:]) if len(rows) else []
    return pa.table(
        {
            "shard": pa.array([shards[r] for r in rows], pa.int64()),
            "kind": pa.array([kind] * len(rows), pa.string()),
            "hashes": pa.array([np.unique(p).tobytes() for p in parts], pa.binary()),
        }
    )


def _later(table: pa.Table, reply: int, kind: str) -> pa.Table:
    """Entries (hash, hash2, doc_id, place) that are not the first of their hash."""
    row, columns = _entries(table, np.uint64, np.uint32, np.int64, np.uint32)
    shard = np.array(table.column("shard").to_pylist())[row]
    order = np.lexsort((columns[3], shard, columns[2], columns[1], columns[0]))
    same = np.zeros(len(order), dtype=bool)
    a, b = columns[0][order], columns[1][order]
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    late = order[same]
    return _answer(table, row[late], columns[reply][late], kind)


ANSWER = "shard long, kind string, hashes binary"


def remove_repeats(docs: DataFrame, length: int = 100, seed: int = _SEED, with_bytes: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier means in a document with a smaller doc_id, or further up in the same document.
    Strings are judged on the input and never cross documents.  Returns one row per input
    row: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` and,
    with ``with_bytes``, ``kept``: the bytes that are left, which may cut a character.

    Strings are told apart by 96 bits of two hashes; ``seed`` bytes make an anchor and do not
    change the result.

    Defined cases: a null or empty text has no bytes; texts shorter than ``length`` stay whole;
    a null doc_id counts as the largest number; rows with the same doc_id come in the order
    of their shards; texts of any length are read whole; other columns are ignored; an empty
    table gives an empty result.
    """
    if not 0 < seed < length:
        raise ValueError("seed must be shorter than length")
    shards, ranges = shard_table(docs)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield Shard({n: batch.column(n)[at].as_py() for n in batch.schema.names}, length, seed)

    def send_anchors(batches):
        for shard in rows_of(batches):
            yield _by_range(ranges, 0, shard.number, shard.anchors())

    def answer_anchors(table: pa.Table) -> pa.Table:
        row, (anchor,) = _entries(table, np.uint64)
        values, counts = np.unique(anchor, return_counts=True)
        often = among(anchor, values[counts > 1])
        return _answer(table, row[often], anchor[often], "shared")

    def send_contexts(batches):
        for shard in rows_of(batches):
            _, whole = shard.shared_parts()
            order = np.argsort(whole["anchor"], kind="stable")
            anchor, starts = np.unique(whole["anchor"][order], return_index=True)
            if not len(anchor):
                continue
            context = whole["context"][order]
            yield _by_range(
                ranges, 0, shard.number, anchor, np.minimum.reduceat(context, starts), np.maximum.reduceat(context, starts)
            )
            context, once = np.unique(whole["context"], return_index=True)
            low = whole["low"][once]
            yield _by_range(
                ranges, ranges, shard.number, context, whole["context2"][once], shard.docs_at(low), low.astype(np.uint32)
            )

    def answer_contexts(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() >= ranges:
            return _later(table, 0, "later")
        row, (anchor, least, most) = _entries(table, np.uint64, np.uint64, np.uint64)
        order = np.argsort(anchor, kind="stable")
        values, starts = np.unique(anchor[order], return_index=True)
        split = np.minimum.reduceat(least[order], starts) != np.maximum.reduceat(most[order], starts)
        mine = among(anchor, values[split])
        return _answer(table, row[mine], anchor[mine], "split")

    def send_strings(batches):
        for shard in rows_of(batches):
            _, (key, key2, start) = shard.open_strings()
            if len(key):
                yield _by_range(ranges, 0, shard.number, key, key2, shard.docs_at(start), start.astype(np.uint32))

    def answer_strings(table: pa.Table) -> pa.Table:
        return _later(table, 3, "strings")

    def finish(batches):
        for shard in rows_of(batches):
            columns = list(zip(*shard.kept(), strict=True))
            digests = [hashlib.sha256(x).hexdigest() for x in columns[4]]
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
            arrays += [pa.array(digests, pa.string()), pa.array(columns[4] if with_bytes else [None] * len(digests), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    asked = shards
    steps = (
        (send_anchors, answer_anchors, ("shared",)),
        (send_contexts, answer_contexts, ("split", "later")),
        (send_strings, answer_strings, ("strings",)),
    )
    for send, answer, kinds in steps:
        replies = stored(asked.mapInArrow(send, PACKED).groupBy("range").applyInArrow(answer, ANSWER), "answers")
        lists = replies.groupBy("shard").agg(
            *[F.collect_list(F.when(F.col("kind") == k, F.col("hashes"))).alias(k) for k in kinds]
        )
        asked = asked.join(lists, "shard", "left")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = asked.mapInArrow(finish, columns)
    return done if with_bytes else done.drop("kept")
