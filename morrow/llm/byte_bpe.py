"""Byte-level BPE as a finite-state transducer, and decoding as a UTF-8 state machine.

A token sequence is what the merges make of its bytes exactly if each token and each pair of
neighbours is (merging their joined bytes gives just them back).  So reading a piece byte by
byte, the encoding of every prefix is unique, and all that the rest of the piece can still
change lies in the open tokens: tokens that began at a recent boundary and whose bytes are so
far a path in the trie of the vocabulary.  A state of the transducer is the list of these
openings, each with the token before it and the tokens not yet emitted on its way; a token is
emitted once all openings agree on it, which happens after at most the longest token's length
of lookahead.  States and transitions are made when they are first met and then kept, so
common words cost one table lookup per byte, and a piece of any length takes linear time.
"""

from __future__ import annotations

import base64
import struct
import sys
import types
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morrow.llm.support import body

#: Transitions and remembered pieces of a worker process; beyond them the table is begun anew.
_TRANSITIONS = 650_000
_PIECES = 500_000
#: Longer pieces go through the transducer each time.
_REMEMBERED_LENGTH = 40
#: Pieces that are read at a time, and bytes of the texts of one output batch.
_PIECES_PER_STEP = 50_000
_BATCH_BYTES = 4 << 20


def load_ranks(path: str) -> bytes:
    """The rank file as it lies on the driver's disk; it is read once and broadcast."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of a token in base64 and its rank."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


#: Parts of a token, each with the rank of the merge that takes it up.
Edge = list[tuple[bytes, int]]
_NEVER = 1 << 62


class Merges:
    """What the merges make of byte strings; the transducer is compiled from it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.ends: dict[int, Edge | None] = {}
        self.begins: dict[int, Edge | None] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Join the neighbours of the least rank, the leftmost first, down to ``stop`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            found = [(self.ranks.get(a + b, -1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            found = [f for f in found if f[0] >= 0]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, known: dict[int, Edge | None], side: int) -> Edge | None:
        """The parts at one end of a token (side 0: begin, -1: end), from a single byte to itself.

        Each comes with the rank of the merge that takes it up; the token itself stays.  None
        if the merges do not lead to the token.
        """
        if token not in known:
            whole = self.bytes_of[token]
            parts: Edge | None = []
            if len(whole) > 1:
                parts = None
                if self.merge(whole) == [whole]:
                    inner = self.merge(whole, stop=2)[side]
                    parts = [*self._edge(self.ranks[inner], known, side)[:-1], (inner, token)]
            known[token] = None if parts is None else [*parts, (whole, _NEVER)]
        return known[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: the beginning of a piece).

        The two parts that meet at the boundary are followed from single bytes to the whole
        tokens.  They must not be joined before one of them is taken up on its own side; of
        equal ranks the leftmost goes first.
        """
        begins = self.begins[right] if right in self.begins else self._edge(right, self.begins, 0)
        if left < 0 or begins is None:
            return begins is not None
        # ``left`` has been emitted, so merges lead to it.
        ends = self.ends[left] if left in self.ends else self._edge(left, self.ends, -1)
        rank_of, rest, others = self.ranks.get, iter(ends), iter(begins)
        (a, a_taken), (b, b_taken) = next(rest), next(others)
        while True:
            joined = rank_of(a + b, _NEVER)
            if joined < a_taken and joined <= b_taken:
                return False
            if a_taken > b_taken:
                b, b_taken = next(others)
            elif a_taken == _NEVER:
                return True
            else:
                a, a_taken = next(rest)


class Transducer:
    """The lazily determinised transducer from bytes to tokens.

    A state is three tuples with an entry per opening: the token before it, its trie node, and
    the tokens due on its way.  State 0 is the beginning of a piece.  As the merging library
    does, a piece that is itself a token becomes that token even where merges do not lead to it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                node = self.trie[key]
            self.token_at[node] = rank
        self.inner = {key >> 8 for key in self.trie}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[tuple, tuple, tuple]] = [((-1,), (0,), ((),))]
        self.number = {self.states[0]: 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.last: dict[int, tuple[int, ...]] = {}

    def _transition(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of a state on a byte."""
        tokens, nodes, dues, ended = [], [], [], None
        for token, node, due in zip(*self.states[state], strict=True):
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            whole = self.token_at.get(node)
            if whole is not None and ended is None and self.merges.fit(token, whole):
                ended = whole
                ended_due = (*due, whole)
            if node in self.inner:
                tokens.append(token)
                nodes.append(node)
                dues.append(due)
        if ended is None:
            raise ValueError("the ranks have no token for a byte, or are not those of merges")
        tokens.append(ended)
        nodes.append(0)
        dues.append(ended_due)
        # Tokens on which all openings agree can no longer change.
        first, shared = dues[0], 0
        while shared < len(first) and all(len(due) > shared and due[shared] == first[shared] for due in dues):
            shared += 1
        if shared:
            dues = [due[shared:] for due in dues]
        key = tuple(tokens), tuple(nodes), tuple(dues)
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        found = self.next[state << 8 | byte] = number, first[:shared]
        return found

    def _last_tokens(self, state: int, byte: int) -> tuple[int, ...]:
        """The tokens due when the piece ends with this byte; no state is made for its end."""
        key = state << 8 | byte
        if key not in self.last:
            found = None
            for token, node, due in zip(*self.states[state], strict=True):
                whole = self.token_at.get(self.trie.get(node << 8 | byte))
                # The beginning of the piece comes first: the whole piece is a token.
                if whole is not None and (token < 0 or self.merges.fit(token, whole)):
                    found = (*due, whole)
                    break
            if found is None:
                raise ValueError("the ranks have no token for a byte, or are not those of merges")
            self.last[key] = found
        return self.last[key]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if len(self.next) + len(self.last) > _TRANSITIONS:
            self._forget()
        if not piece:
            return ()
        state, ids, known = 0, [], self.next
        for byte in piece[:-1]:
            found = known.get(state << 8 | byte) or self._transition(state, byte)
            state = found[0]
            if found[1]:
                ids += found[1]
        return (*ids, *self._last_tokens(state, piece[-1]))


class Encoder:
    """Token ids of texts: each match of the pattern goes through the transducer by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}

    def _steps(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, a bounded number at a time."""
        if len(text) <= _PIECES_PER_STEP and not self.pattern.groups:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while step := [match[0] for match in islice(matches, _PIECES_PER_STEP)]:
            yield step

    def encode_steps(self, text: str) -> Iterator[bytes]:
        """Ids of one text as little-endian 32-bit numbers, in steps of a bounded number of pieces."""
        known = self.pieces
        for step in self._steps(text):
            if len(known) > _PIECES:
                known.clear()
            fresh = sorted(set(step).difference(known))
            for piece in fresh:
                ids = self.transducer.encode_piece(piece.encode())
                known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            yield b"".join(map(known.__getitem__, step))
            for piece in fresh:
                if len(piece) > _REMEMBERED_LENGTH:
                    del known[piece]

    def encode(self, text: str) -> list[int]:
        return ids_of(b"".join(self.encode_steps(text)))


def ids_of(raw: bytes) -> list[int]:
    """Ids from their little-endian 32-bit numbers."""
    return np.frombuffer(raw, "<u4").tolist()


#: The length of a UTF-8 sequence by its first byte (0: no sequence begins so), and the range
#: of its second byte where it is narrower than 0x80 to 0xBF. Fixed values of the encoding.
_LENGTHS = [(0x00, 0x7F, 1), (0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4)]
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class StreamDecoder:
    """Text of token ids as they come; a character is given out once its last byte is there.

    The state is the begun sequence (at most three bytes).  What a token does to a state is
    worked out byte by byte when first met, and then kept.  Bytes that are no UTF-8 become
    U+FFFD, one for each sequence that breaks off, as in common decoders.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.steps: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.whole: dict[int, str] = {}
        self.state = b""

    @staticmethod
    def _length(first: int) -> int:
        return next((n for lo, hi, n in _LENGTHS if lo <= first <= hi), 0)

    def _feed(self, begun: bytes, byte: int) -> tuple[bytes, str]:
        """One step of the machine: the new state and the text that is now complete."""
        if begun:
            low, high = _SECOND.get(begun[0], (0x80, 0xBF)) if len(begun) == 1 else (0x80, 0xBF)
            if not low <= byte <= high:
                state, text = self._feed(b"", byte)
                return state, "�" + text
            grown = begun + bytes([byte])
            return (b"", grown.decode()) if len(grown) == self._length(begun[0]) else (grown, "")
        length = self._length(byte)
        if length == 1:
            return b"", chr(byte)
        return (bytes([byte]), "") if length else (b"", "�")

    def _step(self, begun: bytes, token: int) -> tuple[bytes, str]:
        state, text = begun, ""
        for byte in self.bytes_of[token]:
            state, more = self._feed(state, byte)
            text += more
        self.steps.setdefault(state, {})
        self.steps[begun][token] = state, text
        if not begun and not state:
            self.whole[token] = text
        return state, text

    def decode(self, ids: Sequence[int]) -> str:
        """The text that these further ids complete."""
        if not self.state:
            # Most tokens begin and end between characters and leave the state as it is.
            texts = list(map(self.whole.get, ids))
            if None not in texts:
                return "".join(texts)
        steps, state, parts = self.steps, self.state, []
        for token in ids:
            found = steps[state].get(token) or self._step(state, token)
            state = found[0]
            parts.append(found[1])
        self.state = state
        return "".join(parts)

    def finish(self) -> str:
        """End the stream: a sequence that is still open becomes U+FFFD."""
        open_, self.state = self.state, b""
        return "�" if open_ else ""


def worker_encoder(content: bytes, pattern: str) -> Encoder:
    """The encoder of this worker process, which runs task after task and keeps its tables.

    Functions reach a worker by value and bring globals of their own with each task, so the
    encoder hangs on a module of the process.  Only the last vocabulary's is kept.
    """
    kept = sys.modules.setdefault("_byte_bpe_worker", types.ModuleType("_byte_bpe_worker"))
    key = zlib.crc32(content), len(content), pattern
    if getattr(kept, "key", None) != key:
        kept.encoder, kept.key = Encoder(parse_ranks(content), pattern), key
    return kept.encoder


def _in_groups(columns: list[str], rows: Iterator[tuple[int, tuple]], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``_BATCH_BYTES`` from rows with their sizes."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        values = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=columns)

    for grown, row in rows:
        held.append(row)
        size += grown
        if size >= _BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, check: bool = False) -> DataFrame:
    """Token ids of every text: ``doc_id`` and ``ids`` (little-endian unsigned 32-bit numbers).

    ``ranks_path`` names a rank file (token in base64 and rank, a line each), ``pattern`` splits
    the text; each match is encoded by itself, special tokens are ordinary text.  With ``check``
    the ids are decoded again in the same pass and their text follows as ``decoded``.

    Defined cases: a null or empty text has no ids; rows are independent, so null and repeated
    doc_ids and repeated rows are encoded as they are; texts and pieces of any length are encoded
    whole in linear time; bytes of a text that are no UTF-8 count as U+FFFD; characters that no
    match covers have no ids; other columns are ignored; an empty table gives an empty result.
    """
    content = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = decoder = None

        def rows() -> Iterator[tuple[int, tuple]]:
            nonlocal encoder, decoder
            for batch in batches:
                if encoder is None:
                    encoder = worker_encoder(content.value, pattern)
                    decoder = StreamDecoder(encoder.transducer.merges.bytes_of)
                for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                    text, ids, decoded = raw.as_py().decode(errors="replace"), [], []
                    for step in encoder.encode_steps(text):
                        ids.append(step)
                        if check:
                            decoded.append(decoder.decode(ids_of(step)))
                    row = (doc_id.as_py(), b"".join(ids))
                    if check:
                        decoded.append(decoder.finish())
                        row = (*row, "".join(decoded))
                    yield len(text), row

        names, types = ["doc_id", "ids"], [pa.int64(), pa.binary()]
        if check:
            names, types = [*names, "decoded"], [*types, pa.string()]
        yield from _in_groups(names, rows(), types)

    schema = "doc_id long, ids binary" + (", decoded string" if check else "")
    return docs.select(F.col("doc_id").cast("long"), body().cast("binary").alias("text")).mapInArrow(run, schema)


def decode_tokens(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Texts of token ids: ``doc_id, text`` from ``doc_id, ids`` as ``encode_texts`` gives them.

    Defined cases: null ids give the empty text; an id without a token stops with an error;
    bytes that are no UTF-8 give U+FFFD; other columns are ignored; an empty table gives an
    empty result.
    """
    content = tokens.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None

        def rows() -> Iterator[tuple[int, tuple]]:
            nonlocal decoder
            for batch in batches:
                decoder = decoder or StreamDecoder({rank: token for token, rank in parse_ranks(content.value).items()})
                for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                    text = decoder.decode(ids_of(raw.as_py() or b"")) + decoder.finish()
                    yield len(text), (doc_id.as_py(), text)

        yield from _in_groups(["doc_id", "text"], rows(), [pa.int64(), pa.string()])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def token_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The columns of query op13: ids of all texts and what they decode to."""
    rows = encode_texts(docs, ranks_path, pattern, check=True)
    return rows.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
