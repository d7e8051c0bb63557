"""Quality classifier from weak labels.

Simple labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns of all documents estimates how each labeller votes on good and on bad ones, and with that the chance that
a pattern comes from a good document. These posteriors are the soft labels of a linear scorer over hashed
character shapes, fitted on a bounded sample, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.llm.store import only_ids, written
from harvestry.llm.words import CHUNK_ROWS, Words, chunks

DIMENSIONS = 2048
#: Documents that the scorer is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 3000
KEEP_FROM = 0.5
LABELLERS = ("repetition", "symbols", "capitals", "bare_marks", "word_length", "sentences", "variety")
_ABSTAIN, _BAD, _GOOD = 0, 1, 2


class Measures(NamedTuple):
    """Per text: words, their mean length, and shares."""

    words: np.ndarray
    length: np.ndarray  # bytes of a word
    distinct: np.ndarray  # of words
    repeats: np.ndarray  # words equal to the one before
    symbols: np.ndarray  # bytes that are neither letters, digits, blanks nor . , ' - of all bytes
    capitals: np.ndarray  # of ASCII letters
    marks: np.ndarray  # words without a letter or digit
    stops: np.ndarray  # words that end in . ! ? or :


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def measure(words: Words) -> Measures:
    data, n = words.data, np.maximum(words.counts, 1)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper = (data >= 65) & (data <= 90)
    solid = letter | (data >= 128) | ((data >= 48) & (data <= 57))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = ~(solid | blank | np.isin(data, np.frombuffer(b".,'-", np.uint8)))
    first, bytes_ = words.first, np.maximum(np.diff(words.offsets), 1)
    rows = np.repeat(np.arange(len(words.counts)), words.counts)
    same = np.zeros(len(words.hashes), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((words.hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (rows[1:] != rows[:-1])
    inside = np.concatenate([[0], np.cumsum(solid)])
    bare = inside[words.ends] == inside[words.starts]
    stop = np.isin(data[words.ends - 1], np.frombuffer(b".!?:", np.uint8)) if len(words.ends) else np.zeros(0, bool)
    return Measures(
        words.counts, _sums(words.ends - words.starts, first) / n, _sums(new, first) / n, _sums(same, first) / n,
        _sums(symbol, words.offsets) / bytes_, _sums(upper, words.offsets) / np.maximum(_sums(letter, words.offsets), 1),
        _sums(bare, first) / n, _sums(stop, first) / n)


def votes(m: Measures) -> np.ndarray:
    """One column per labeller: 0 nothing, 1 bad, 2 good."""

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, _BAD, np.where(good, _GOOD, _ABSTAIN))

    some, many, never = m.words > 0, m.words >= 20, np.zeros(len(m.words), bool)
    prose = some & (m.stops < 0.5) & (m.length > 2) & (m.length < 14)
    columns = [  # most look for one fault and say nothing where they don't find it
        vote(many & (m.repeats > 0.2), never),
        vote(some & (m.symbols > 0.06), never),
        vote(many & (m.capitals > 0.4), never),
        vote(many & (m.marks > 0.2), never),
        vote(some & ((m.length < 2) | (m.length > 16)), prose & (m.symbols < 0.03)),
        vote((m.words >= 60) & ((m.stops < 0.005) | (m.stops > 0.5)), prose & (m.stops > 0.01) & (m.repeats < 0.1)),
        vote((m.words >= 60) & (m.words < 5000) & (m.distinct < 0.2), never),
    ]
    return np.stack(columns, 1)


class Labelling(NamedTuple):
    prior: float  # share of good documents
    tables: np.ndarray  # chance of each vote of each labeller on bad and on good documents

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that documents with these votes are good."""
        logs = np.log(self.tables)[np.arange(patterns.shape[1])[None], :, patterns].sum(1)
        logs = logs + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Chance that a labeller that votes is right."""
        right = (1 - self.prior) * self.tables[:, 0, _BAD] + self.prior * self.tables[:, 1, _GOOD]
        cast = (1 - self.prior) * self.tables[:, 0, 1:].sum(1) + self.prior * self.tables[:, 1, 1:].sum(1)
        return dict(zip(LABELLERS, (right / cast).round(4).tolist()))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Labelling:
    """Expectation-maximisation from a vote in which a fault outweighs two praises; patterns without any vote say nothing."""
    good = np.clip(0.5 + 0.45 * np.sign((patterns == _GOOD).sum(1) - 3.0 * (patterns == _BAD).sum(1)), 0.05, 0.95)
    model = Labelling(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        tables = np.stack([[(weight * (patterns[:, j] == v)).sum(1) + 0.5 for v in range(3)] for j in range(patterns.shape[1])])
        tables = tables.transpose(0, 2, 1)
        model = Labelling(
            float(np.clip(weight[1].sum() / max(weight.sum(), 1), 0.01, 0.99)), tables / tables.sum(2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-6:
            break
        good = new
    return model


def shapes(words: Words, m: Measures) -> np.ndarray:
    """Hashed trigrams of character classes as square-rooted shares, and the repetition of words."""
    table = np.full(256, 3, np.uint32)
    table[33:127] = np.arange(33, 127)  # marks stand for themselves
    table[48:58], table[65:91], table[97:123], table[128:] = 1, 2, 4, 4
    table[[9, 10, 11, 12, 13, 32]] = 5
    classes = table[words.data]
    rows = np.repeat(np.arange(len(words.counts)), np.diff(words.offsets))
    out = np.zeros((len(words.counts), DIMENSIONS + 3), np.float32)
    if len(classes) > 2:
        code = (classes[:-2] << 14) | (classes[1:-1] << 7) | classes[2:]
        slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64)
        own = rows[:-2] == rows[2:]
        counts = np.bincount(rows[:-2][own] * DIMENSIONS + slot[own], minlength=len(out) * DIMENSIONS).reshape(-1, DIMENSIONS)
        out[:, :DIMENSIONS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    out[:, DIMENSIONS:] = np.stack([m.repeats, m.words * 0 + 1, np.where(m.words >= 60, np.maximum(0.3 - m.distinct, 0), 0)], 1)
    return out


def fit(x: np.ndarray, good: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w, last = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    if not len(x):
        return w
    step = 4 / float((x * x).sum(1).mean() + decay)
    for i in range(rounds):
        ahead = w + i / (i + 3) * (w - last)
        error = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - good
        last, w = w, ahead - step * (x.T @ error / len(x) + decay * ahead)
    return w


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scale = 3 ** np.arange(len(LABELLERS))
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            code = votes(measure(Words(part.column("text")))) @ scale
            counts += np.bincount(code, minlength=len(counts))
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["pattern", "n"])


def weak_labels(docs: DataFrame, text_col: str = "text") -> Labelling:
    """The labelling model of all documents with words: one count per vote pattern reaches the driver (3^7 at most)."""
    texts = docs.select(F.col(text_col).alias("text")).filter(r"text rlike '[^\x20\x09-\x0D]'")
    rows = texts.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows = sorted((r["pattern"], r["n"]) for r in rows)
    codes, counts = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), ())))
    return estimate(codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, counts)


def score_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep_from: float = KEEP_FROM,
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``kept`` (score at least ``keep_from``), one row per input row.

    Null texts and texts without words have score 0. Rows without an id are scored but not learned from; repeated
    rows have equal scores, and of rows that share an id one text is learned from. Input columns with the names of the new ones are replaced. An empty table gives an
    empty result.
    """
    new = ["score", "kept"]
    labelling = weak_labels(docs, text_col)
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")).filter(r"key is not null and text rlike '[^\x20\x09-\x0D]'")
    picked = written(rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample), "quality-sample")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", rows=CHUNK_ROWS):
                words = Words(part.column("text"))
                m = measure(words)
                x = shapes(words, m)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(labelling.posterior(votes(m))), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "good", "x"])

    # `sample` ids at most, of 8 kB each
    texts = only_ids(rows, picked, "key").groupBy("key").agg(F.min("text").alias("text"))  # one text of each id
    got = sorted(tuple(r) for r in texts.mapInArrow(vectors, "key string, good double, x binary").collect())
    x = np.stack([np.frombuffer(r[2], np.float32) for r in got]) if got else np.zeros((0, DIMENSIONS + 3), np.float32)
    weights = fit(x, np.array([r[1] for r in got])).astype(np.float32)
    carried = [c for c in docs.columns if c not in new]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", rows=CHUNK_ROWS):
                words = Words(part.column("_text"))
                found = 1 / (1 + np.exp(-np.clip((shapes(words, measure(words)) @ weights).astype(np.float64), -30, 30)))
                found = np.where(words.counts > 0, found, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), pa.array(found), pa.array((found >= keep_from) & (words.counts > 0))], [*carried, *new])

    added = [T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    out = docs.select(*carried, F.col(text_col).alias("_text"))
    return out.mapInArrow(score, T.StructType([*(docs.schema[c] for c in carried), *added]))
