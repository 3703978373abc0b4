"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector joins the hashed vectors of the word and of three of its prefixes, so
inflected forms share evidence.  Filters of widths 1, 2 and 3 run over the whole text, the
maximum of each filter is kept, and a linear layer gives a logit.  Embeddings start from
smoothed log-ratios of document counts; then everything is trained by gradient steps.

Thresholds are calibrated by language.  The language is guessed from function words of the
text, never read from a column; each language's threshold is moved to the score 0.7.

The model is fitted on at most ``max_rows`` labelled rows, half of each class where possible.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morrow.llm.support import body, documents_like

CUT = 0.7
_BUCKETS = 1 << 17
_PREFIXES = (3, 4, 6)
_PARTS = 1 + len(_PREFIXES)
_EACH = 4
_DIM, _FILTERS, _WIDTHS = _PARTS * _EACH, 8, (1, 2, 3)
_PAD = max(_WIDTHS) - 1
_TRIM = ".,*#$%&|;:!?()[]\"'"
_CACHE = 300_000
_GROUP_CHARS = 2 << 20

# Common function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with was are on this be at by from or an".split(),
    "de": "der die das und ist nicht ein eine zu den von mit für auf dem sich des auch wir es".split(),
    "fr": "le la les et des est une un que dans pour du qui pas au sur avec ne il ce".split(),
    "es": "el los que y en un por las con para una su se lo del al como más pero si".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)


def word_buckets(word: str) -> tuple[int, ...]:
    """Hash buckets of a word and of its prefixes (the word itself where it is shorter)."""
    raw = [word, *(f"{n}:{word[:n]}" for n in _PREFIXES)]
    return tuple(zlib.crc32(x.encode(errors="replace")) % _BUCKETS for x in raw)


class Words:
    """Index of the words met so far: their buckets and languages."""

    def __init__(self):
        self.spoken = {}
        for at, lang in enumerate(LANGUAGES):
            for word in FUNCTION_WORDS[lang]:
                self.spoken[word] = self.spoken.get(word, 0) | 1 << at
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.buckets = array("i", [0] * _PARTS)
        self.langs = array("b", [0])

    def learn(self, tokens: set[str]) -> None:
        for token in tokens:
            if token not in self.index:
                word = token.strip(_TRIM)
                self.index[token] = len(self.langs)
                self.buckets.extend(word_buckets(word))
                self.langs.append(self.spoken.get(word, 0))

    def table(self) -> np.ndarray:
        """The buckets of each word, in the order of their numbers."""
        return np.array(self.buckets, dtype=np.int64).reshape(-1, _PARTS)

    def line_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, ``_PAD`` zeros after each; where each begins."""
        split = [text.lower().split() for text in texts]
        tokens = [w for each in split for w in each]
        self.learn(set(tokens))
        line = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(counts)
        line = np.insert(line, np.repeat(ends, _PAD), 0)
        return line, ends - counts + _PAD * np.arange(len(split))


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about ``_GROUP_CHARS``, so that few words are held at a time."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _GROUP_CHARS or i + 1 == len(texts):
            yield texts[start : i + 1]
            start, size = i + 1, 0


@dataclass
class Model:
    embeddings: np.ndarray  # bucket x part of dim
    taps: list[np.ndarray]  # per width: tap x dim x filter
    shift: np.ndarray  # width * filter
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray  # per language, the last for an unknown one

    def arrays(self) -> tuple:
        """The fields, which are plain numbers and arrays."""
        return self.embeddings, self.taps, self.shift, self.weights, self.bias, self.thresholds

    def vectors(self, words: Words) -> np.ndarray:
        found = self.embeddings[words.table()].reshape(-1, _DIM)
        found[0] = 0.0
        return found

    def features(self, vectors: np.ndarray, line: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each text."""
        pooled = []
        for width, taps in zip(_WIDTHS, self.taps, strict=True):
            projected = [(vectors @ tap).astype(np.float32) for tap in taps]
            response = projected[0][line]
            for step in range(1, width):
                response[:-step] += projected[step][line[step:]]
            pooled.append(np.maximum.reduceat(response, begins, axis=0))
        return np.maximum(np.concatenate(pooled, axis=1) + self.shift, 0)

    def logits(self, words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language (index; ``len(LANGUAGES)`` if unknown) of each text."""
        if not texts:
            return np.empty(0), np.empty(0, dtype=np.int64)
        line, begins = words.line_up(texts)
        logit = self.features(self.vectors(words), line, begins) @ self.weights + self.bias
        flags = np.array(words.langs, dtype=np.int64)[line]
        counts = np.stack([np.add.reduceat(flags >> i & 1, begins) for i in range(len(LANGUAGES))], axis=1)
        lang = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(LANGUAGES))
        return logit, lang

    def scores(self, words: Words, texts: list[str]) -> np.ndarray:
        logit, lang = self.logits(words, texts)
        x = np.clip(logit - self.thresholds[lang], -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-x))


def _log_ratios(words: Words, lines: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per bucket, the smoothed log-ratio of the shares of toxic and clean texts that hold it."""
    counts = np.zeros((2, _BUCKETS))
    buckets = words.table()
    for line, label in zip(lines, labels, strict=True):
        if len(line):
            counts[label, np.unique(buckets[line])] += 1
    sizes = np.array([[np.sum(labels == 0)], [np.sum(labels == 1)]])
    share = counts / sizes + 1 / len(labels)
    return np.log(share[1] / share[0])


def fit_filters(
    words: Words, lines: list[np.ndarray], labels: np.ndarray, epochs: int = 5, batch: int = 64, seed: int = 7
) -> Model:
    """Gradient steps (Adagrad) on the cross-entropy with both classes weighted alike."""
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.05, (_BUCKETS, _EACH))
    embeddings[:, 0] = _log_ratios(words, lines, labels) / 4
    taps = [rng.normal(0, 0.05, (w, _DIM, _FILTERS)) for w in _WIDTHS]
    for each in taps:
        each[0, np.arange(_PARTS) * _EACH, np.arange(_PARTS)] = 1.0
    n = _FILTERS * len(_WIDTHS)
    weights = rng.normal(0, 0.05, n)
    for k in range(len(_WIDTHS)):
        weights[k * _FILTERS : k * _FILTERS + _PARTS] = 0.5
    shift, bias = np.zeros(n), -1.0
    buckets = words.table()
    share = np.array([max(1, np.sum(labels == c)) for c in (0, 1)]) / len(labels)
    sums = {"e": np.full((_BUCKETS, 1), 1e-2), "t": [np.full(x.shape, 1e-2) for x in taps], "w": np.full(n, 1e-2), "s": np.full(n, 1e-2), "b": 1e-2}
    rate = 0.05
    for _ in range(epochs):
        order = rng.permutation(len(lines))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            grad_t = [np.zeros_like(x) for x in taps]
            grad_w, grad_s, grad_b = np.zeros(n), np.zeros(n), 0.0
            places, moves = [], []
            for i in some:
                line = np.concatenate([lines[i], np.zeros(_PAD, dtype=np.int32)])
                x = embeddings[buckets[line]].reshape(-1, _DIM)
                x[line == 0] = 0.0
                hidden, where = np.empty(n), []
                for k, (width, tap) in enumerate(zip(_WIDTHS, taps, strict=True)):
                    last = len(line) - width + 1
                    response = sum(x[t : t + last] @ tap[t] for t in range(width))
                    best = response.argmax(axis=0)
                    where.append(best)
                    hidden[k * _FILTERS : (k + 1) * _FILTERS] = response[best, np.arange(_FILTERS)]
                hidden += shift
                active = np.maximum(hidden, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ weights + bias, -30, 30)))
                error = (p - labels[i]) / (2 * share[labels[i]] * len(some))
                grad_w += error * active
                grad_b += error
                back = error * weights * (hidden > 0)
                grad_s += back
                for k, (width, tap) in enumerate(zip(_WIDTHS, taps, strict=True)):
                    pull = back[k * _FILTERS : (k + 1) * _FILTERS]
                    for t in range(width):
                        spots = where[k] + t
                        grad_t[k][t] += x[spots].T * pull
                        places.append(line[spots])
                        moves.append((tap[t] * pull).T)
            place, move = np.concatenate(places), np.concatenate(moves)
            real = place > 0
            rows, back_to = np.unique(buckets[place[real]], return_inverse=True)
            grad_e = np.zeros((len(rows), _EACH))
            np.add.at(grad_e, back_to.reshape(-1), move[real].reshape(-1, _EACH))
            sums["e"][rows] += (grad_e**2).mean(axis=1, keepdims=True)
            embeddings[rows] -= rate * grad_e / np.sqrt(sums["e"][rows])
            for k, g in enumerate(grad_t):
                sums["t"][k] += g**2
                taps[k] -= rate * g / np.sqrt(sums["t"][k])
            sums["w"] += grad_w**2
            weights -= rate * grad_w / np.sqrt(sums["w"])
            sums["s"] += grad_s**2
            shift -= rate * grad_s / np.sqrt(sums["s"])
            sums["b"] += grad_b**2
            bias -= rate * grad_b / np.sqrt(sums["b"])
    return Model(
        embeddings.astype(np.float32), taps, shift, weights, float(bias), np.zeros(len(LANGUAGES) + 1)
    )


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the highest F1; between the two logits that it parts, where it has a choice."""
    order = np.argsort(-logits, kind="stable")
    ranked, hits = logits[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + hits[-1])
    f1[:-1][ranked[:-1] == ranked[1:]] = -1
    at = int(f1.argmax())
    below = ranked[at + 1] if at + 1 < len(ranked) else ranked[at] - 2.0
    return float((ranked[at] + below) / 2)


def fit(texts: list[str], labels: np.ndarray, calibrates: np.ndarray) -> Model:
    """Train on the texts that do not calibrate; set thresholds with those that do.

    Without both classes the score is constant: 0 below the cut, whatever the text.
    """
    labels = np.asarray(labels, dtype=np.int64)
    words, lines = Words(), []
    for group in grouped(texts):
        line, begins = words.line_up(group)
        ends = np.append(begins[1:], len(line)) - _PAD
        lines += [line[a:b].astype(np.int32) for a, b in zip(begins, ends, strict=True)]
    train = ~calibrates
    if len(set(labels[train].tolist())) < 2:
        train = np.ones(len(labels), dtype=bool)
    if len(set(labels.tolist())) < 2:
        empty = [np.zeros((w, _DIM, _FILTERS)) for w in _WIDTHS]
        n = _FILTERS * len(_WIDTHS)
        return Model(
            np.zeros((_BUCKETS, _EACH), np.float32), empty, np.zeros(n), np.zeros(n), -5.0, np.zeros(len(LANGUAGES) + 1)
        )
    model = fit_filters(words, [x for x, t in zip(lines, train, strict=True) if t], labels[train])
    chosen = calibrates if len(set(labels[calibrates].tolist())) == 2 else np.ones(len(labels), dtype=bool)
    found = [model.logits(words, g) for g in grouped([t for t, c in zip(texts, chosen, strict=True) if c])]
    logits, langs = (np.concatenate(part) for part in zip(*found, strict=True))
    truth = labels[chosen]
    model.thresholds[:] = best_threshold(logits, truth)
    for lang in range(len(LANGUAGES)):
        own = langs == lang
        if min(np.sum(truth[own] == 0), np.sum(truth[own] == 1)) >= 8:
            model.thresholds[lang] = best_threshold(logits[own], truth[own])
    return model


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows from which no label is learnt; a null doc_id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, label: str = "toxic") -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    At most half of them are of either class; they are those with the smallest hashes, so
    the choice depends on nothing but doc_ids.  A doc_id with several labels is toxic if
    one of them says so; null labels are not used.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("known_id"))
        .agg(F.max(F.col(label).cast("int")).alias("known"))
    )
    half = max_rows // 2
    chosen = [
        known.where(F.col("known") == value).orderBy(F.xxhash64("known_id"), "known_id").limit(half)
        for value in (0, 1)
    ]
    # At most ``max_rows`` pairs of integers.
    pairs = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    rows = (
        texts.join(pairs, F.col("doc_id") == F.col("known_id"))
        .groupBy("doc_id", "known")
        .agg(F.min("text").alias("text"))
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        ids, known, bodies = zip(*sample, strict=True) if sample else ((), (), ())
        calibrates = np.array([zlib.crc32(f"c{i}".encode()) % 4 == 0 for i in ids], dtype=bool)
        model = fit(list(bodies), np.array(known, dtype=np.int64), calibrates)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.arrays())], pa.binary())], names=["model"])

    # One task fits the bounded sample, so the driver only sees the model.
    found = rows.coalesce(1).mapInArrow(fitted, "model binary").first()
    return Model(*pickle.loads(found["model"])) if found else fit([], np.empty(0), np.empty(0, dtype=bool))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``score`` to the ``carry`` columns of each row.  The model has a fixed size."""
    # Plain arrays: a broadcast of the class would need this package on every executor.
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())
    names = [f"c{i}" for i in range(len(carry))]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), Model(*shared.value)
        for batch in batches:
            texts = batch.column("body").to_pylist()
            found = []
            for group in grouped(texts):
                found.append(model.scores(words, group))
                if len(words.index) > _CACHE:
                    words.forget()
            value = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(value, pa.float64())], names=[*names, "score"]
            )

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], body().alias("body"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    done = rows.mapInArrow(scored, f"{kinds}, score double")
    return done.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "score")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """Score every text: ``doc_id, held_out, score`` (0 to 1), ``predicted`` (1 from 0.7 on).

    Defined cases: a null text is scored like an empty one; texts of any length are read
    in full; rows with null or repeated doc_ids are scored one by one; without labels of
    both classes every score is the same, below the cut; other columns are ignored; an
    empty table gives an empty result.
    """
    model = train(docs, labels, max_rows)
    return score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """The documents that the classifier does not reject, with the columns of ``documents``.

    Defined cases are those of ``toxicity``: null and empty texts are scored and so kept or
    rejected like others, repeated rows stay or go together, other columns are dropped, and
    an empty table gives an empty result.
    """
    model = train(docs, labels, max_rows)
    columns = tuple(documents_like(docs).columns)
    return documents_like(score(docs, model, columns).where(F.col("score") < CUT))
