"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item of n distinct shingles lies in a document with containment c if at least ceil(c n) of its shingles
occur there, so a contaminated document misses at most n - ceil(c n) of them. The item's sketch is its
bottom-k MinHash with k = n - ceil(c n) + 1, chosen per size: any such document holds one of the k
shingles with the smallest hashes. Long documents are not sketched at all; their shingles stream past the
sketches of the items, so the answer does not depend on how long they are. A hit is verified on the
shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.jaccard import SHINGLE, shingles_of
from harvestry.llm.store import pieces
from harvestry.llm.words import Words, chunks

#: Text bytes of one block of items; a block's sketches travel with the job (some 20 MB at most).
BLOCK_BYTES = 4 << 20


def _lowered(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _shingle_texts(text: str, length: int) -> set[bytes]:
    """Distinct shingles as text: bytes.lower and bytes.split know A-Z and ASCII blanks only."""
    words = _lowered(text)
    if len(words) < length:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)}


def _search(items: list[tuple[int, str]], containment: float, length: int):
    """Documents against one block of items."""
    ids = np.array([i for i, _ in items], np.int64)
    h, rows = shingles_of(pa.array([t for _, t in items], pa.string()), length)
    n = np.bincount(rows, minlength=len(items))
    need = np.ceil(containment * n - 1e-9).astype(np.int64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    low = place < (n - need + 1)[rows]  # hashes are sorted within an item
    order = np.argsort(h[low], kind="stable")
    sketch, owner = h[low][order], rows[low][order]
    sets: dict[int, set[bytes]] = {}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), lower=True)
                at, docs = words.whole_runs(length)
                own = words.runs(length)[at] if len(at) else np.empty(0, np.uint64)
                short = np.flatnonzero((words.counts > 0) & (words.counts < length))
                if len(short):
                    few, few_docs = shingles_of(part.column("text").take(pa.array(short)), length)
                    own, docs = np.concatenate([own, few]), np.concatenate([docs, short[few_docs]])
                slot = np.searchsorted(sketch, own)
                hit = (slot < len(sketch)) & (sketch[np.minimum(slot, len(sketch) - 1)] == own) if len(sketch) else np.zeros(len(own), bool)
                if not hit.any():
                    continue
                candidates: dict[int, set[int]] = {}
                for value, d in set(zip(own[hit].tolist(), docs[hit].tolist())):
                    lo, hi = np.searchsorted(sketch, np.uint64(value), "left"), np.searchsorted(sketch, np.uint64(value), "right")
                    candidates.setdefault(d, set()).update(owner[lo:hi].tolist())
                out = []
                doc_ids = part.column("id").to_pylist()
                for d, found in candidates.items():
                    mine = _shingle_texts(part.column("text")[d].as_py(), length)
                    for i in found:
                        if i not in sets:
                            sets[i] = _shingle_texts(items[i][1], length)
                        shared = len(sets[i] & mine)
                        if shared >= need[i]:
                            out.append((doc_ids[d], int(ids[i]), shared, len(sets[i]), shared / len(sets[i])))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                        ["id", "item_id", "n_shared", "n_item", "containment"])

    return search


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", containment: float = 0.75, length: int = SHINGLE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id``, ``item_id``, ``n_shared``, ``n_item``, ``containment``: documents that hold a test item.

    Items with equal texts count once, under their smallest id. The items are split into blocks of bounded size,
    whatever their number, and all documents are searched for each block. Null and blank texts, items
    without an id and documents without an id give no rows; an item shorter than a shingle is one shingle,
    found in documents of the same few words only. Rows that share an id are searched each. Other columns
    of either table play no part. Empty tables give an empty result.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    items = items.filter("item is not null and text is not null").groupBy("text").agg(F.min("item").alias("item"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = pieces(size, block_bytes)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    schema = "id long, item_id long, n_shared long, n_item long, containment double"
    found = None
    for block in range(blocks):
        # at most about block_bytes of text, whatever the size of the benchmark
        some = [(r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        part = texts.mapInArrow(_search(some, containment, length), schema)
        found = part if found is None else found.union(part)
    return found
