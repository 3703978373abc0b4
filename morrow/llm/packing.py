"""Packing of token sequences: large items are matched in pairs, small ones best-fit the gaps.

Only lengths matter for packing, and there are at most ``capacity`` of them.  So the plan is
made from the histogram of lengths: bins of the same content form a class with a count, and
the plan's size depends on the capacity, not on the number of documents.  Each piece has
a rank among the pieces of its length (its task's offset plus a counter inside the task),
and the plan says which place belongs to that rank.  Token ids are read once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morrow.llm.support import body, stored

END_ID = 1
_GROUP_BYTES = 1 << 22
#: Words that a worker process remembers; then it starts anew.
_WORDS = 600_000
_PER_CALL = 512
_MARK = "<|endoftext|>"
_WORD_END = "</w>"
#: What a byte is to the splitting of words; a word also ends between a letter and a closing byte.
_OTHER, _SPACE, _LETTER, _CLOSING = range(4)
_KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _bytes in (
    (_SPACE, b" \t\n\r\x0b\x0c"),
    (_LETTER, b"abcdefghijklmnopqrstuvwxyz0123456789"),
    (_CLOSING, b".,*#$%&|;:!?"),
):
    _KINDS[list(_bytes)] = _kind


class WordEncoder:
    """Token ids of texts, with the ids of words seen before kept.

    The tokenizer drops white space, ignores case, and never joins what white space parts or
    an ASCII letter or digit with the punctuation after it.  So a text's ids are those of
    its lower-case words and punctuation in turn.  ``encode`` returns all ids of a group of
    texts, each closed by ``END_ID``, and the number of ids of each text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.mark_id = self.tokenizer.token_to_id(_MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.array([END_ID], dtype="<u4")
        self.starts = np.zeros(1, dtype=np.int64)
        self.lengths = np.ones(1, dtype=np.int64)

    def _coded(self, text: str) -> np.ndarray:
        (coded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(coded.ids, dtype="<u4")

    def _ids(self, words: list[str], letters: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and lengths of words, many in one call.

        A word of letters only has one id that ends a word, or more, never none.  So where a
        call has as many of these as words, they part the words; else a special token does.
        """
        for at in range(0, len(words), _PER_CALL):
            some = words[at : at + _PER_CALL]
            if letters:
                ids = self._coded(" ".join(some))
                ends = np.flatnonzero(self.ends_word[ids])
                if len(ends) == len(some):
                    yield ids, np.diff(ends, prepend=-1)
                    continue
            ids = self._coded(_MARK.join(some))
            marks = np.flatnonzero(ids == self.mark_id)
            yield np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1

    def _learn(self, words: list[bytes]) -> None:
        """Keep the ids of distinct words."""
        if len(self.index) > _WORDS:
            self._forget()
        letters, mixed, special = [], [], []
        for word in words:
            if word not in self.index:
                text = word.decode()
                (letters if text.isalpha() else special if "<|" in text else mixed).append(text)
        parts = [*self._ids(letters, True), *self._ids(mixed, False)]
        for ids in map(self._coded, special):
            parts.append((ids, np.array([len(ids)])))
        if not parts:
            return
        fresh = [w.encode() for w in (*letters, *mixed, *special)]
        lengths = np.concatenate([p[1] for p in parts])
        self.index.update(zip(fresh, range(len(self.lengths), len(self.lengths) + len(fresh)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, *(p[0] for p in parts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raws, plain = [], []
        for text in texts:
            raw = text.encode(errors="replace")
            # A special token is looked for before case is dropped.
            plain.append(b"<|" not in raw)
            raws.append(raw.lower() if plain[-1] else raw)
        data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        kind = _KINDS[data]
        shown = kind != _SPACE
        closing = (kind[1:] == _CLOSING) & (kind[:-1] == _LETTER)
        if not all(plain):
            closing &= np.repeat(plain, sizes)[1:]
        begins = shown.copy()
        begins[1:] &= (kind[:-1] == _SPACE) | closing
        at = np.flatnonzero(begins)
        offsets = np.append(np.cumsum(shown)[at] - 1, np.count_nonzero(shown))
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[shown])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        distinct = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        known = distinct[coded.indices.to_numpy()]
        ends = np.searchsorted(at, np.cumsum(sizes))
        known = np.insert(known, ends, 0)  # entry 0 is END_ID
        lengths = self.lengths[known]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[known] - total[:-1], lengths) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total[ends + np.arange(1, len(texts) + 1)]])
        return ids, np.diff(bounds)


_encoders: dict[str, WordEncoder] = {}


def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which runs task after task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def grouped_texts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_GROUP_BYTES`` each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _GROUP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``place`` counts a task's pieces of each length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in grouped_texts(texts):
                ids, counts = encoder.encode(texts[at:to])
                rows: list[tuple] = []
                base = 0
                for doc_id, count in zip(doc_ids[at:to], counts.tolist(), strict=True):
                    for piece, start in enumerate(range(0, count, capacity)):
                        part = ids[base + start : base + min(count, start + capacity)].tobytes()
                        length = len(part) // 4
                        rows.append(
                            (doc_id, piece, start, length, zlib.crc32(part), task, int(seen[length]), part)
                        )
                        seen[length] += 1
                    base += count
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t)
                        for c, t in zip(columns[: len(kinds)], kinds, strict=True)
                    ],
                    names=names,
                )

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = PIECES
    if with_ids:
        names, kinds, schema = [*names, "ids"], [*kinds, pa.binary()], PIECES + ", ids binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return stored(rows.mapInArrow(pieces, schema), "pieces")


@dataclass
class BinClass:
    """``count`` bins of the same content; ``items`` are (length, how many)."""

    count: int
    gap: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def split(self, count: int, length: int, copies: int) -> BinClass:
        """Take ``count`` of the bins away and add ``copies`` items to each of them."""
        self.count -= count
        return BinClass(count, self.gap - copies * length, [*self.items, (length, copies)])


def plan_bins(histogram: dict[int, int], capacity: int) -> list[BinClass]:
    """Large-item matching over a histogram of lengths (1 to ``capacity``).

    Items above a third of the capacity go from the longest down: each is paired with the
    longest other one that still fits.  Smaller items, longest first, go to the bin with the
    smallest gap that holds them; a bin is opened where none does.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    third = capacity // 3
    gaps: dict[int, list[BinClass]] = {}
    for length in range(capacity, third, -1):
        while left[length]:
            fitting = np.flatnonzero(left[third + 1 : capacity - length + 1]) + third + 1
            fitting = fitting[(fitting < length) | (left[length] >= 2)]
            fitting = fitting[fitting <= length]
            if len(fitting):
                other = int(fitting[-1])
                count = int(left[length] // 2 if other == length else min(left[length], left[other]))
                items = [(length, 2)] if other == length else [(length, 1), (other, 1)]
            else:
                other, count, items = 0, int(left[length]), [(length, 1)]
            left[length] -= count
            if other:
                left[other] -= count
            gap = capacity - length - other
            gaps.setdefault(gap, []).append(BinClass(count, gap, items))
    for length in range(third, 0, -1):
        while left[length]:
            need = int(left[length])
            gap = min((g for g in gaps if g >= length), default=capacity)
            copies = gap // length
            source = gaps[gap][-1] if gap in gaps else BinClass(need // copies + 1, capacity)
            count = min(source.count, need // copies)
            if not count:
                count, copies = 1, need
            made = source.split(count, length, copies)
            if gap in gaps and not source.count:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            gaps.setdefault(made.gap, []).append(made)
            left[length] -= count * copies
    return [each for gap in sorted(gaps) for each in gaps[gap]]


def place_table(plan: list[BinClass], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (base rank, first bin, offset) by length and base; where each length begins."""
    rows, base, first = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for each in plan:
        offset = 0
        for length, copies in each.items:
            for _ in range(copies):
                rows.append((length, base[length], first, offset))
                base[length] += each.count
                offset += length
        first += each.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 1:], np.searchsorted(table[:, 0], np.arange(capacity + 2))


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces."""
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task = stored(by_task, "lengths")
    # At most ``capacity`` rows: one per length.
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, begins = place_table(plan_bins(histogram, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.drop("task", "place", "before")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            rows = np.empty(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                lo, hi = begins[length], begins[length + 1]
                rows[mine] = lo + np.searchsorted(table[lo:hi, 0], ranks[mine], side="right") - 1
            sequence = table[rows, 1] + ranks - table[rows, 0]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(table[rows, 2])],
                names=[*kept, "sequence_id", "offset"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(places, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """Place all documents in sequences of at most ``capacity`` ids.

    A document's ids are its text's ids and ``END_ID``.  Longer ones are cut into pieces of
    ``capacity`` ids, the last of which may be shorter.  Returns one row per piece: ``doc_id,
    piece`` (from 0), ``start, length, ids_crc32`` (of the ids as little-endian 32-bit numbers),
    ``sequence_id, offset``; the pieces of a sequence follow each other without gaps.

    Defined cases: a null or empty text has the one id ``END_ID``; rows are independent, so
    null or repeated doc_ids and repeated rows are packed as they are; other columns are
    ignored; an empty table gives an empty result.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place_pieces(token_pieces(docs, tokenizer_path, capacity), capacity).select(*names)


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """The sequences themselves: ``sequence_id, input_ids`` and the ``segments`` they are made of."""
    placed = place_pieces(token_pieces(docs, tokenizer_path, capacity, with_ids=True), capacity)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
            yield batch.drop_columns(["ids"]).append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    columns = "sequence_id long, offset long, doc_id long, piece int, length long"
    rows = placed.select("sequence_id", "offset", "doc_id", "piece", "length", "ids")
    parts = rows.mapInArrow(decode, f"{columns}, ids array<int>")
    segment = F.struct("offset", "doc_id", "piece", "length", "ids")
    return (
        parts.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(segment)).alias("segments"))
        .select(
            "sequence_id",
            F.flatten("segments.ids").alias("input_ids"),
            F.transform("segments", lambda s: s.dropFields("ids")).alias("segments"),
        )
    )
