"""Substring deduplication by prefix-partitioned suffix trees.

Every word position starts a suffix. A suffix is coded by the path it takes in a suffix tree cut at
the window length: three edge labels (words 1-4, 5-8 and the rest) of 24, 20 and 20 bits. Variable-length
code prefixes split the suffixes into groups of bounded size: a prefix whose group is too large is
extended until its parts fit. Each group is one subtree, built in one task by sorting.

The path code says only which group a suffix is in: its labels are short, so windows that share their first
words would often get equal codes. Two windows of a group are equal if a 64-bit hash of all their words is.

A window that occurs in a document with a smaller id is removed from the later one. Within a batch
only the first document of a window is sent on, so a passage in a third of all documents reaches its
subtree once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from harvestry.llm.store import default_parallelism, pieces
from harvestry.llm.words import SENT_BYTES, Words, chunks, mix, sorted_chunks

WINDOW = 13
#: Suffixes of one group (8 bytes each, some 60 MB while the group is read), and those of them that are sorted at once.
GROUP_SUFFIXES, SORTED_SUFFIXES = 3_000_000, 250_000
#: Text of one bucket of documents where marks and texts meet.
BUCKET_BYTES = 12 << 20
_BITS = 12


def codes_of(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path codes of all suffixes of at least ``window`` words, their first words and their rows."""
    at, rows = words.whole_runs(window)
    if not len(at):
        return np.empty(0, np.uint64), at, rows
    first = min(4, window)
    second = min(4, window - first)
    third = window - first - second
    code = (words.runs(first)[at] >> np.uint64(40)) << np.uint64(40)
    if second:
        code |= (mix(words.runs(second, first)[at]) >> np.uint64(44)) << np.uint64(20)
    if third:
        code |= mix(words.runs(third, first + second)[at]) >> np.uint64(44)
    return code, at, rows


def _distinct(whole: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (step, hash of the window), by step and then hash, and which of them each input is."""
    order = np.lexsort((whole, step))
    whole, step = whole[order], step[order]
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (step[1:] != step[:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return whole[new], step[new], back


def prefix_groups(texts: DataFrame, window: int, group_suffixes: int) -> tuple[np.ndarray, int]:
    """Lower bounds of the groups, and the bytes of all texts.

    Counted over all documents; long prefixes are taken only where short ones hold too much.
    """

    def histogram(depth: int, inside: np.ndarray):
        shift = np.uint64(64 - depth)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
            for batch in batches:
                for part in chunks(batch, "text"):
                    words = Words(part.column("text"))
                    size += len(words.data)
                    prefix = codes_of(words, window)[0] >> shift
                    if len(inside):
                        parent = prefix >> np.uint64(_BITS)
                        prefix = prefix[inside[np.minimum(np.searchsorted(inside, parent), len(inside) - 1)] == parent]
                    keys, back = np.unique(np.concatenate([found[0], prefix]), return_inverse=True)
                    weights = np.concatenate([found[1], np.ones(len(prefix), np.int64)])
                    found = keys, np.bincount(back, weights, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(found[0].view(np.int64), -1)), pa.array(np.append(found[1], size))], ["prefix", "n"])

        counted = texts.select("text").mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        rows = sorted((r["prefix"], r["n"]) for r in counted.collect())  # 2^12 rows per prefix that was too full
        return rows[1:], rows[0][1] if rows else 0

    bounds, depth, full, total = [0], _BITS, np.empty(0, np.uint64), None
    while depth <= 60:
        too_full, held = [], 0
        rows, size = histogram(depth, full)
        total = size if total is None else total
        for prefix, n in rows:
            if n > group_suffixes:
                too_full.append(prefix)
            if held and held + n > group_suffixes:
                bounds.append(prefix << (64 - depth))
                held = 0
            held += n
        if not too_full:
            break
        full, depth = np.array(too_full, np.uint64), depth + _BITS
    return np.unique(np.array(bounds, np.uint64)), total


def _suffixes(bounds: np.ndarray, window: int):
    """Per batch and group: the distinct window hashes that no smaller document of the batch has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sorted_chunks(batch, "id", "text", SENT_BYTES):
                if out := sent_of(part):
                    names = ["grp", "ids", "hashes", "counts", "later", "windows"]
                    kinds = [pa.int32()] + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def sent_of(part: pa.RecordBatch) -> list[tuple]:
        ids, hashes = (part.column(c).to_numpy() for c in ("id", "text_hash"))
        whole, rows, group = windows_of(part)
        order = np.lexsort((whole, group))  # within a window by id, as rows are
        same = np.zeros(len(whole), bool)
        same[1:] = (whole[order][1:] == whole[order][:-1]) & (group[order][1:] == group[order][:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(whole))))
        later = np.zeros(len(whole), bool)
        later[order] = ids[rows[order]] > ids[rows[order[lead]]]
        del order, same, lead
        by_group = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[by_group], prepend=-1))
        out = []
        for mine in np.split(by_group, cuts[1:]) if len(cuts) else []:
            starts = np.flatnonzero(np.diff(rows[mine], prepend=-1))
            docs = rows[mine[starts]]
            out.append((int(group[mine[0]]), ids[docs].tobytes(), hashes[docs].tobytes(),
                        np.diff(starts, append=len(mine)).astype(np.int32).tobytes(),
                        np.packbits(later[mine]).tobytes(), whole[mine[~later[mine]]].tobytes()))
        return out

    def windows_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(part.column("text"))
        code, at, rows = codes_of(words, window)
        if not len(code):
            return code, rows, at
        whole, step, _ = _distinct(words.runs(window)[at], np.searchsorted(bounds, code, "right") - 1 + rows * len(bounds))
        return whole, *np.divmod(step, len(bounds))

    return send


def _subtrees(buckets: int):
    """Marks per document and group: which of its distinct windows a smaller document has. Gathered by bucket of documents."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, current = [], None
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in zip(*batch.slice(at, 64).to_pydict().values()))
        for g, *raw in rows:
            if parts and g != current:  # groups come one after the other
                yield from of_group(current, parts)
                parts = []
            parts.append(raw)
            current = g
        if parts:
            yield from of_group(current, parts)

    def of_group(g: int, parts: list) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, later, windows = [], [], [], [], []
        for raw in parts:
            ids.append(np.frombuffer(raw[0], np.int64))
            hashes.append(np.frombuffer(raw[1], np.int32))
            counts.append(np.frombuffer(raw[2], np.int32))
            later.append(np.unpackbits(np.frombuffer(raw[3], np.uint8), count=int(counts[-1].sum())).view(bool))
            windows.append(np.frombuffer(raw[4], np.uint64))
        parts.clear()
        ids, hashes, counts, marks = (np.concatenate(x) for x in (ids, hashes, counts, later))
        windows = np.concatenate(windows)
        marks[~marks] = repeated(windows, ids, np.cumsum(counts) - np.cumsum(np.add.reduceat(marks, np.cumsum(counts) - counts, dtype=np.int64)))
        ends = np.cumsum(counts)
        which = np.flatnonzero(np.add.reduceat(marks, ends - counts)) if len(ends) else ends
        bucket = hashes[which] % buckets
        which = which[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for some in np.split(which, cuts[1:]) if len(which) else []:
            bits = b"".join(np.packbits(marks[ends[i] - counts[i] : ends[i]]).tobytes() for i in some)
            raw = (ids[some], hashes[some], counts[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(hashes[some[0]]) % buckets], pa.int32()), pa.array([g], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in raw),
                 pa.array([bits], pa.binary())], ["_bucket", "grp", "ids", "hashes", "counts", "bits"])

    def repeated(windows: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which windows a smaller id has, of rows that end at ``ends``; sorted by stretches of their first bits."""
        out = np.empty(len(windows), bool)
        stretches = pieces(len(windows), SORTED_SUFFIXES)
        stretch = np.empty(len(windows), np.int16)
        for at in range(0, len(windows), SORTED_SUFFIXES):
            some = slice(at, at + SORTED_SUFFIXES)
            stretch[some] = (windows[some] >> np.uint64(48)) * np.uint64(stretches) >> np.uint64(16)
        for k in range(stretches):
            mine = np.flatnonzero(stretch == k)
            own, owner_id = windows[mine], ids[np.searchsorted(ends, mine, "right")]
            order = np.argsort(own, kind="stable")
            own, owner_id, mine = own[order], owner_id[order], mine[order]
            starts = np.flatnonzero(np.diff(own, prepend=~own[:1]))
            least = np.minimum.reduceat(owner_id, starts) if len(starts) else owner_id
            out[mine] = owner_id > np.repeat(least, np.diff(starts, append=len(mine)))
        return out

    return mark


def _keep(bounds: np.ndarray, window: int, text_col: str, schema: pa.Schema, new: list[str]):
    """Removes the marked windows from each text of a bucket."""

    def keep(docs: pa.Table, sent: pa.Table) -> pa.Table:
        marks: dict[tuple[int, int], list] = {}
        for row in sent.select(["grp", "ids", "hashes", "counts", "bits"]).to_pylist():
            counts, at = np.frombuffer(row["counts"], np.int32), 0
            bits = row["bits"]
            for i, h, n in zip(np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["hashes"], np.int32).tolist(), counts.tolist()):
                marks.setdefault((i, h), []).append((row["grp"], bits[at : at + (n + 7) // 8]))
                at += (n + 7) // 8
        out = []
        for batch in docs.to_batches():
            for part in chunks(batch, text_col):
                added = kept_of(part, marks)
                out.append(pa.RecordBatch.from_arrays([added[f.name] if f.name in new else part.column(f.name) for f in schema], schema=schema))
        return pa.Table.from_batches(out, schema)

    def kept_of(part: pa.RecordBatch, marks: dict) -> dict:
        words = Words(part.column(text_col))
        code, at, rows = codes_of(words, window)
        whole, group = words.runs(window)[at] if len(at) else code, np.searchsorted(bounds, code, "right") - 1
        ids, hashes = part.column("_suffix_id").to_pylist(), part.column("_suffix_hash").to_pylist()
        covered = np.zeros(len(words.hashes) + 1, np.int64)
        cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
        for d, key in enumerate(zip(ids, hashes)):
            if key not in marks:
                continue
            own, groups, back = _distinct(whole[cut[d] : cut[d + 1]], group[cut[d] : cut[d + 1]])
            gone = np.zeros(len(own), bool)
            for g, bits in marks[key]:
                lo, hi = np.searchsorted(groups, [g, g + 1])
                gone[lo:hi] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).view(bool)
            starts = at[cut[d] : cut[d + 1]][gone[back]]
            covered[starts] += 1
            covered[starts + window] -= 1
        removed = np.cumsum(covered)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        gone_of = total[words.first[1:]] - total[words.first[:-1]]
        texts, shas = [], []
        body = words.data.tobytes()
        for d in range(part.num_rows):
            lo, hi = words.first[d], words.first[d + 1]
            if gone_of[d]:
                left = np.flatnonzero(~removed[lo:hi]) + lo
                kept = b" ".join([body[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist())])
            else:
                kept = b" ".join(body[words.offsets[d] : words.offsets[d + 1]].split())
            texts.append(kept.decode("utf-8", "replace"))
            shas.append(hashlib.sha256(kept).hexdigest())
        return {"n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(gone_of.astype(np.int64)),
                "kept_text": pa.array(texts, pa.string()), "kept_sha256": pa.array(shas, pa.string())}

    return keep


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_text`` and ``kept_sha256``, one row per input row.

    Each word covered by a window of ``window`` words that also starts in a document with a smaller id is
    removed; windows are judged on the input. Null or blank texts have no words. Rows without an id, and
    rows that share an id, are never removed for one another; texts shorter than a window stay whole.
    Whitespace between kept words becomes one space. Input columns with the names of the new ones are
    replaced. An empty table gives an empty result.
    """
    new = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    # tells rows of one id apart; the bucket of a document follows from it
    text_hash = F.xxhash64(id_col, text_col).bitwiseAND(F.lit(2**31 - 1)).cast("int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    texts = texts.filter("id is not null and text is not null")
    bounds, size = prefix_groups(texts, window, group_suffixes)
    buckets = pieces(size, BUCKET_BYTES)
    tasks = max(min(len(bounds), default_parallelism(docs.sparkSession)), len(bounds) // 4)
    sent = texts.mapInArrow(_suffixes(bounds, window), "grp int, ids binary, hashes binary, counts binary, later binary, windows binary")
    marks = sent.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(
        _subtrees(buckets), "_bucket int, grp int, ids binary, hashes binary, counts binary, bits binary")
    carried = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *carried, *([] if text_col in carried else [text_col]), F.col(id_col).cast("long").alias("_suffix_id"),
        text_hash.alias("_suffix_hash"), (text_hash % buckets).alias("_bucket"))
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in carried), *added])
    keep = _keep(bounds, window, text_col, to_arrow_schema(schema), new)
    return rows.groupBy("_bucket").cogroup(marks.groupBy("_bucket")).applyInArrow(keep, schema)
