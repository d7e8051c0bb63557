"""Language identification: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the lower-cased letters, as square roots of their shares, over the whole
text. A linear SVM per family (one against the rest) picks the family; a linear SVM per pair of languages
of that family votes for the language. The models are fitted on a bounded sample: at most
``per_language`` documents of each language, those with the smallest hash of their id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.llm.store import only_ids, written
from harvestry.llm.words import CHUNK_ROWS, chunks

UNKNOWN = "und"
DIMENSIONS = 4096
#: Documents of each language that the models are fitted on, at most.
PER_LANGUAGE = 500
#: Languages of one family; any other language is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "da": "germanic", "sv": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}


def features(texts: pa.Array) -> np.ndarray:
    """One row of square-rooted trigram shares per text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    # a blank on both sides of each text, so that its first and last words have edges, too
    size = np.diff(offsets)
    starts = np.cumsum(size + 2) - (size + 2)
    padded = np.full(int(size.sum()) + 2 * len(size), 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(starts + 1 - (offsets[:-1] - offsets[0]), size)] = table[data]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(padded) < 3:
        return out
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size + 2)[:-2]
    inside = (owner == np.repeat(np.arange(len(size)), size + 2)[2:]) & (code != 0x202020)
    counts = np.bincount(owner[inside] * DIMENSIONS + slot[inside], minlength=len(texts) * DIMENSIONS)
    counts = counts.reshape(len(texts), DIMENSIONS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM, by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1) + 0.5 / cost
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gap = y[i] * (x[i] @ w) - 1 + 0.5 / cost * alpha[i]
            new = max(alpha[i] - gap / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model(NamedTuple):
    families: list[str]
    family_weights: np.ndarray  # one column per family
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]


def fit(langs: np.ndarray, x: np.ndarray) -> Model:
    family = np.array([FAMILIES.get(lang, lang) for lang in langs.tolist()], object)
    families = sorted(set(family.tolist()))
    weights = [linear_svm(x, np.where(family == f, 1, -1)) for f in families] if len(families) > 1 else [np.zeros(DIMENSIONS + 1)] * len(families)
    members = {f: sorted(set(langs[family == f].tolist())) for f in families}
    pairs = {}
    for f in families:
        for a, b in itertools.combinations(members[f], 2):
            two = (langs == a) | (langs == b)
            pairs[a, b] = linear_svm(x[two], np.where(langs[two] == a, 1, -1))
    return Model(families, np.array(weights).reshape(-1, DIMENSIONS + 1), members, pairs)


def predict(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score: the logistic of twice the narrowest margin on the way."""
    if not len(x) or not model.families:
        return [UNKNOWN] * len(x), np.zeros(len(x))
    by_family = x @ model.family_weights[:, :-1].T + model.family_weights[:, -1]
    best = by_family.argmax(1)
    ordered = np.sort(by_family, 1)
    margin = ordered[:, -1] - ordered[:, -2] if len(model.families) > 1 else np.full(len(x), 8.0)
    langs = np.empty(len(x), object)
    for f, name in enumerate(model.families):
        rows, members = np.flatnonzero(best == f), model.members[name]
        votes, narrow = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), 8.0)
        for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
            side = x[rows] @ model.pairs[a, b][:-1] + model.pairs[a, b][-1]
            for winner, won in ((i, side), (j, -side)):
                votes[:, winner] += won > 0
                narrow[:, winner] = np.minimum(narrow[:, winner], won)
        first = (votes + np.tanh(narrow) / 4).argmax(1)  # equal votes: the wider margin
        langs[rows] = np.array(members, object)[first]
        margin[rows] = np.minimum(margin[rows], narrow[np.arange(len(rows)), first])
    return langs.tolist(), 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> Model:
    """The model of the labelled documents outside the held-out fifth, from ``per_language`` of each language."""
    key = F.col(id_col).cast("string")
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.crc32(key) % 5 != 0))
    keys = rows.select(F.col(lang_col).alias("lang"), key.alias("key"), F.xxhash64(key).alias("hash"))
    # a row per language: the smallest hashes lie below the share of all hashes that some eight times too many ids have
    shares = keys.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    below = F.least(F.lit(8.0) * per_language / F.col("n"), F.lit(1.0)) * 2.0**64 - 2.0**63
    near = keys.join(F.broadcast(shares.select("lang", below.alias("below"))), "lang").filter("hash <= below").select("lang", "key", "hash").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "key"))
    picked = near.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    picked = written(picked.select("key").distinct(), "language-sample")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", rows=CHUNK_ROWS):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "lang", "x"])

    texts = only_ids(rows.select(key.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), picked, "key")
    # one text of each id and language, whatever repeats it
    texts = texts.groupBy("key", "lang").agg(F.min("text").alias("text"))
    # at most per_language of each, of 16 kB
    got = sorted(tuple(r) for r in texts.mapInArrow(vectors, "key string, lang string, x binary").collect())
    x = np.stack([np.frombuffer(v, np.float32) for *_, v in got]) if got else np.zeros((0, DIMENSIONS), np.float32)
    return fit(np.array([r[1] for r in got], object), x)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, one row per input row.

    Learns from rows with a language and a letter whose crc32(id as text) mod 5 is not 0; predicts from the
    whole text alone. Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is
    nothing to learn from. Rows without an id are not held out and not learned from; repeated rows get equal
    predictions, and of rows that share id and language one text is learned from. Input columns named like the new ones are replaced. An empty table gives an empty result.
    """
    new = ["held_out", "lang_pred", "score"]
    model = train(docs, id_col, text_col, lang_col, per_language)
    carried = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *carried, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(text_col).alias("_text"),
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", rows=CHUNK_ROWS):
                langs, scores = predict(model, features(part.column("_text")))
                letters = part.column("_letters")
                langs = pc.if_else(letters, pa.array(langs, pa.string()), UNKNOWN)
                scores = pc.if_else(letters, pa.array(scores.astype(np.float64)), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), part.column("held_out"), langs, scores], [*carried, *new])

    added = [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(label, T.StructType([*(docs.schema[c] for c in carried), *added]))
