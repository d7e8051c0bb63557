"""N-gram Jaccard join by parity sketches.

A document's shingles are hashed and dealt into K parts; XOR of the hashes in a part is its sketch word.
Two sets that differ in d shingles differ in at most d sketch words, so with K - d more than the parts
that are empty, some part that is not empty is equal: the pigeonhole join looks up (part, word) keys. K
belongs to a size band (sets of the smaller size in [64 (4/3)^(b-1), 64 (4/3)^b)); a document takes part in
its own band and in the one below, as the larger of a pair. At a Jaccard similarity of 3/4 the smaller set,
of n shingles, differs from the other in at most n/3. Whether K leaves enough parts is counted for every
document beforehand, and a band whose K is too small gets a larger one. Sets under 64 shingles use each
shingle as a part. So no link is lost.

Candidates are filtered by a second parity sketch, of single bits, whose Hamming distance is a lower bound of
the symmetric difference, and then verified on all shingles. Equal sets are linked through their
fingerprint. Where more than ``LISTED`` documents share a key, or so many of one batch that it sends on only the
first, they are first compared only with the one of them that stands under most such keys; all documents of
such a key are entries of it, those of other batches, too. A linked pair has more equal parts than one, by a number that is known for each
document; if more of a document's keys are crowded than that, and it is not connected to the others
of the key after the first comparison, they are compared in blocks, in which only pairs that pass the bit
sketch leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.components import components
from harvestry.llm.store import default_parallelism, only_ids, pieces, release, written
from harvestry.llm.words import SENT_BYTES, Words, chunks, mix, sorted_chunks

SHINGLE = 5
#: Keys of one group of the join (16 bytes each with the sort), and the bytes of a key that are sent: within a group the
#: others are known but for its width. Keys that these don't tell apart only add candidates, which are verified.
GROUP_KEYS, KEY_BYTES = 2_000_000, 5
#: Documents that share a key, up to which all pairs are listed at once.
LISTED = 32
#: Rows of one block where larger groups are compared.
BLOCK = 1024
#: Pairs listed at once, and bytes of bit sketches compared at once.
PAIRS, SKETCH_BYTES = 400_000, 16 << 20
#: Rows of crowded keys that are compared in one task, about.
TASK_ROWS = 250_000
SMALL = 64
_KEY_BITS = np.uint64(8 * KEY_BYTES)
_LOW = (np.uint64(1) << _KEY_BITS) - np.uint64(1)
_RATIO = 4 / 3
_LEVELS = 12


def shingles_of(texts: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, by row and hash; a shorter text is one shingle."""
    words = Words(texts, lower=True)
    at, rows = words.whole_runs(length)
    hashes = [words.runs(length)[at] if len(at) else np.empty(0, np.uint64)]
    owners = [rows]
    for k in range(1, length):
        own = np.flatnonzero(words.counts == k)
        if len(own):
            hashes.append(mix(words.runs(k)[words.first[own]] ^ np.uint64(k)))
            owners.append(own)
    h, rows = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], rows[new]


def band_of(n: np.ndarray) -> np.ndarray:
    """0 below 64 shingles, then bands of ratio 4/3."""
    top = np.array([SMALL * _RATIO**b for b in range(0, 120)])
    return np.searchsorted(top, n, "right").astype(np.int64)


def parts_of(band: int, level: int = 0) -> int:
    """K of a band: 6 standard deviations of spare parts at level 0, more at higher levels; 0: a part for each shingle."""
    if band == 0 or level >= _LEVELS:
        return 0
    high = SMALL * _RATIO**band

    def spare(k: int) -> float:
        worst = math.inf
        for n in (high, high / _RATIO):
            rate = math.exp(-n / k)
            worst = min(worst, k - n / 3 - k * rate - 6 * math.sqrt(k * rate * (1 - (1 + n / k) * rate)) - 1)
        return worst

    k = int(high / 3)
    while spare(k) <= 0:
        k += max(1, k // 50)
        if k > high:
            return 0
    return int(k * 1.3**level)


def _parts(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(32)) * k.astype(np.uint64)) >> np.uint64(32)


def _signatures(length: int):
    """Per row: set size, fingerprint, bit sketch, band, the level its band needs, and the least equal parts of a linked pair."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, rows = shingles_of(part.column("text"), length)
                n = np.bincount(rows, minlength=part.num_rows)
                first = np.concatenate([[0], np.cumsum(n)])
                some = np.flatnonzero(n)
                fp1, fp2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                level, margin = np.zeros(len(n), np.int32), np.zeros(len(n), np.int64)
                band = band_of(n)
                if len(some):
                    fp1[some] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5)), first[some])
                    fp2[some] = np.bitwise_xor.reduceat(mix(h + np.uint64(0x5A5A)), first[some])
                    k = np.array([parts_of(b) for b in range(int(band.max()) + 1)])[band]
                    at = _parts(h, k[rows])
                    used = np.ones(len(h), bool)
                    used[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
                    filled = np.where(k > 0, np.bincount(rows[used], minlength=len(n)), n)
                    margin = np.maximum(filled - n // 3, 0)
                    for d in np.flatnonzero((band > 0) & (filled <= n // 3)):
                        mine = h[first[d] : first[d + 1]]
                        while (more := parts_of(int(band[d]), int(level[d]))) and len(np.unique(_parts(mine, np.full(len(mine), more)))) <= n[d] // 3:
                            level[d] += 1
                width = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
                base = np.concatenate([[0], np.cumsum(width)])
                bits = np.bincount(base[rows] + (h & (width[rows] - 1).astype(np.uint64)).astype(np.int64), minlength=base[-1]) & 1
                packed = np.packbits(bits.astype(np.uint8)).tobytes()
                sketch = [packed[base[d] // 8 : base[d + 1] // 8] for d in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n.astype(np.int64)), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)),
                     pa.array(sketch, pa.binary()), pa.array(band.astype(np.int32)), pa.array(level), pa.array(margin)],
                    ["id", "n", "fp1", "fp2", "sketch", "band", "level", "margin"])

    return sign


def _keys(h: np.ndarray, rows: np.ndarray, band: np.ndarray, k_of_band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch words as 64-bit keys, with their rows, of each row in the band given for it."""
    k = k_of_band[band][rows]
    at = np.where(k == 0, h, _parts(h, k))
    cut = np.ones(len(h), bool)
    cut[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(cut)
    if not len(starts):
        return np.empty(0, np.uint64), rows[starts]
    word = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x77)), starts)
    place = mix(band[rows[starts]].astype(np.uint64) * np.uint64(1 << 40) + np.where(k[starts] == 0, np.uint64(0), at[starts]))
    return mix(word ^ place), rows[starts]


def _sketch_words(k_of_band: np.ndarray, groups: int, length: int):
    """Keys of each batch, gathered per group; documents of one set, and large groups of a batch, send the first.

    ``more`` tells by a bit per key where a batch has more documents than it sends to the group.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sorted_chunks(batch, "id", "text", SENT_BYTES):
                yield from sent_of(part)

    def sent_of(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = part.column("id").to_numpy()
        h, rows = shingles_of(part.column("text"), length)
        n = np.bincount(rows, minlength=len(ids))
        some = np.flatnonzero(n)
        if not len(some):
            return
        start = (np.cumsum(n) - n)[some]
        print_of = np.stack([n[some], np.add.reduceat(mix(h ^ np.uint64(0xA5A5)), start).view(np.int64)])
        lead = np.zeros(len(ids), bool)
        lead[some[np.unique(print_of, axis=1, return_index=True)[1]]] = True
        h, rows = h[lead[rows]], rows[lead[rows]]
        band = band_of(n)
        own, below = _keys(h, rows, band, k_of_band), None
        lower = (band > 0)[rows]
        below = _keys(h[lower], rows[lower], np.maximum(band - 1, 0), k_of_band)
        key, row = np.concatenate([own[0], below[0]]), np.concatenate([own[1], below[1]])
        key = (((key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)) << _KEY_BITS) | (key & _LOW)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        size = np.diff(starts, append=len(key))
        crowded = np.repeat(size > 8, size)
        busy = np.bincount(row[crowded], minlength=len(ids))
        order = np.lexsort((row, -busy[row], key))
        key, row = key[order], row[order]
        head = np.zeros(len(key), bool)
        head[starts] = True
        local = crowded & ~head
        if local.any():
            least = row[np.repeat(starts, size)]
            a, b = ids[row[local]], ids[least[local]]
            spread = int(ids[0]) % 1009
            yield _blobs([-1 - spread], [a], [b], [np.ones(0, np.int32)], [key[local]], [np.ones(0, bool)])
            # the first of the batch is an entry of the group, too
            heads = head & crowded
            yield _blobs([-1 - spread], [ids[row[heads]]], [ids[row[heads]]], [np.ones(0, np.int32)], [key[heads]], [np.ones(0, bool)])
        key, row, more = key[~local], row[~local], crowded[~local]
        group = (key >> _KEY_BITS).astype(np.int64)
        order = np.lexsort((row, group))
        key, row, group, more = key[order], row[order], group[order], more[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        out: list[list] = [[], [], [], [], [], []]
        for lo, hi in zip(cuts, np.append(cuts[1:], len(group))):
            docs = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
            own_rows = row[lo:hi][docs]
            for column, value in zip(out, (int(group[lo]), ids[own_rows], n[own_rows], np.diff(docs, append=hi - lo).astype(np.int32), key[lo:hi], more[lo:hi])):
                column.append(value)
        yield _blobs(*out)

    return send


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as the least of them and the distances from it in as few bytes as the largest needs."""
    numbers = np.ascontiguousarray(numbers, np.int64)
    low = numbers.min(initial=np.iinfo(np.int64).max) if len(numbers) else np.int64(0)
    above = numbers.view(np.uint64) - np.int64(low).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(above) or int(above.max()) < 1 << 8 * w)
    return int(low).to_bytes(8, "little", signed=True) + bytes([width]) + above.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    above = np.frombuffer(raw, f"<u{raw[8]}", offset=9).astype(np.uint64)
    return (above + np.frombuffer(raw, "<i8", 1).view(np.uint64)).view(np.int64)


def _blobs(groups, ids, sizes, counts, keys, more) -> pa.RecordBatch:
    """Groups below 0 are no groups of the join: they hold pairs of ids in ``ids`` and ``sizes``, and whole keys."""
    raw = lambda xs: pa.array([_packed(x) for x in xs], pa.binary())
    paired = bool(groups) and groups[0] < 0
    sent = [np.ascontiguousarray(k, "<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if paired else KEY_BYTES].tobytes() for k in keys]
    return pa.RecordBatch.from_arrays(
        [pa.array(groups, pa.int32()), raw(ids), raw(sizes), raw(counts), pa.array(sent, pa.binary()),
         pa.array([np.packbits(m).tobytes() for m in more], pa.binary())],
        ["grp", "ids", "sizes", "counts", "keys", "more"])


def _found(key, a, b) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 100_000):
        part = slice(i, i + 100_000)
        keys = pa.nulls(len(a[part]), pa.int64()) if key is None else pa.array(key[part].view(np.int64))
        yield pa.RecordBatch.from_arrays([keys, pa.array(a[part]), pa.array(b[part])], ["key", "a", "b"])


def _pigeonholes(listed: int):
    """Pairs of documents that share a key (key null), and the entries of crowded keys (b null)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, current = [], None
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in zip(*batch.slice(at, 64).to_pydict().values()))
        for g, ids, sizes, counts, keys, more in rows:
            if g < 0:
                a, b, keys = _unpacked(ids), _unpacked(sizes), np.frombuffer(keys, np.uint64)
                apart = a != b
                yield from _found(None, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
                yield from _found(keys, a, a)
                continue
            if parts and g != current:  # groups come one after the other
                yield from of_group(parts)
                parts = []
            low = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
            low[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
            low = low.view("<u8").ravel()
            parts.append((_unpacked(ids), _unpacked(sizes).astype(np.int32), _unpacked(counts).astype(np.int32), low | np.uint64(g) << _KEY_BITS,
                          np.unpackbits(np.frombuffer(more, np.uint8), count=len(low)).view(bool)))
            current = g
        if parts:
            yield from of_group(parts)

    def of_group(parts: list) -> Iterator[pa.RecordBatch]:
        ids, sizes, counts, keys, more = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        size = np.diff(starts, append=len(keys))
        # a batch has kept documents of these back: the pairs with those are left to the blocks
        held = np.zeros(0, bool) if not len(starts) else np.logical_or.reduceat(more[order], starts)
        entry = np.repeat(held & (size > 1) & (size <= listed), size)
        yield from _found(keys[entry], ids[owner[entry]], ids[owner[entry]])
        left, right = [], []
        for c in np.unique(size[(size > 1) & (size <= listed)]):
            table = owner[starts[size == c][:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            for lo in range(0, len(table), max(1, PAIRS // len(i))):
                some = table[lo : lo + max(1, PAIRS // len(i))]
                a, b = some[:, i].ravel(), some[:, j].ravel()
                near = (3 * np.maximum(sizes[a], sizes[b]) <= 4 * np.minimum(sizes[a], sizes[b])) & (ids[a] != ids[b])
                both = np.unique(np.stack([np.maximum(ids[a], ids[b])[near], np.minimum(ids[a], ids[b])[near]], 1), axis=0)
                left.append(both[:, 0])
                right.append(both[:, 1])
        crowded = np.repeat(size > listed, size)
        busy = np.bincount(owner[crowded], minlength=len(ids))
        # one document may have several rows here, one per batch
        busy = np.bincount(np.unique(ids, return_inverse=True)[1], busy)[np.unique(ids, return_inverse=True)[1]]
        for s, c in zip(starts[size > listed], size[size > listed]):
            mine = ids[owner[s : s + c]]
            yield from _found(np.full(c, keys[s]), mine, mine)
            hub = mine[np.lexsort((mine, -busy[owner[s : s + c]]))[0]]
            others = mine[mine != hub]
            left.append(np.maximum(others, hub))
            right.append(np.minimum(others, hub))
        if left:
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            yield from _found(None, both[:, 0], both[:, 1])

    return join


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """A parity sketch of fewer bits: bits that meet are XORed, as the hash modulo the width would have done."""
    while sketch.shape[-1] > width:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _hamming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bit sketches allow the similarity."""
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        keep = []
        for x, y, limit in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), (na + nb) // 7):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            width = min(len(x), len(y))
            keep.append(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum(dtype=np.int64) <= limit)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_rows(length: int):
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, rows = shingles_of(part.column("text"), length)
                cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([h[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])], pa.binary())], ["id", "set"])

    return rows_of


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 |A and B| >= 75 |A or B|."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of crowded keys that the bit sketches allow and that are not connected yet.

    The rows come sorted by key and pair of blocks (i, j); a group is one block (i = j) or two.
    """
    rest: list[pa.RecordBatch] = []
    found: list[np.ndarray] = []
    kept = [0]  # pairs after the last time that repeated ones were dropped

    def compare(table: pa.Table) -> None:
        ids, n, comp, side, open_ = (table.column(c).to_numpy() for c in ("id", "n", "component", "side", "open"))
        group = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        cuts = np.append(np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)]), len(ids))
        sketches = [np.frombuffer(s, np.uint8) for s in table.column("sketch").to_pylist()]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo < 2:
                continue
            mine = np.arange(lo, hi)
            left, right = (mine, mine) if group[lo, 1] == group[lo, 2] else (mine[side[lo:hi] == 0], mine[side[lo:hi] == 1])
            width = min(len(s) for s in sketches[lo:hi])
            bits = np.stack([fold(s, width) for s in sketches[lo:hi]]).view(np.uint64)
            for part in np.array_split(left, max(1, len(left) // 128)):
                x, y = part[:, None], right[None]
                fits = (comp[x] != comp[y]) & (open_[x] | open_[y]) & (3 * np.maximum(n[x], n[y]) <= 4 * np.minimum(n[x], n[y]))
                a, b = np.nonzero(fits)
                a, b = part[a], right[b]
                step = max(64, SKETCH_BYTES // (8 * bits.shape[1]))
                for at in range(0, len(a), step):
                    p, q = a[at : at + step], b[at : at + step]
                    near = np.bitwise_count(bits[p - lo] ^ bits[q - lo]).sum(1, dtype=np.int64) <= (n[p] + n[q]) // 7
                    if near.any():
                        found.append(np.stack([np.maximum(ids[p], ids[q])[near], np.minimum(ids[p], ids[q])[near]], 1))
                if sum(map(len, found)) > 2 * kept[0] + 300_000:
                    found[:] = [np.unique(np.concatenate(found), axis=0)]
                    kept[0] = len(found[0])

    def pairs() -> Iterator[pa.RecordBatch]:
        if found:
            both = np.unique(np.concatenate(found), axis=0)
            found.clear()
            kept[0] = 0
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    for batch in (b.slice(at, 2 * BLOCK) for b in batches for at in range(0, b.num_rows, 2 * BLOCK)):
        keys = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        ends = np.flatnonzero(np.any([k != k[-1] for k in keys], 0)) if batch.num_rows else []
        whole = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on in the next batch
        if whole or (rest and batch.num_rows and any(k[-1] != rest[-1].column(c)[-1].as_py() for k, c in zip(keys, ("key", "i", "j")))):
            compare(pa.Table.from_batches([*rest, batch.slice(0, whole)]).combine_chunks())
            rest = []
        rest.append(batch.slice(whole))
        if kept[0] > 1_000_000:
            yield from pairs()
    if rest:
        compare(pa.Table.from_batches(rest).combine_chunks())
    yield from pairs()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` per input row: groups linked at a Jaccard similarity of 3/4.

    Words are lower-cased in A-Z only; texts shorter than a shingle are one shingle; null and blank texts
    have none and link with nothing. Rows without an id have no component. Rows that share an id are one
    document with several texts, each of which may link it. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_signatures(length), "id long, n long, fp1 long, fp2 long, sketch binary, band int, level int, margin long"), "signatures")
    with_id = signed.filter("id is not null and n > 0")
    needs = {r["band"]: (r["level"], r["total"]) for r in with_id.groupBy("band").agg(F.max("level").alias("level"), F.sum("n").alias("total")).collect()}
    k_of_band = np.array([parts_of(b, needs.get(b, (0,))[0]) for b in range(max(needs, default=0) + 1)])
    tasks = default_parallelism(spark)
    groups = pieces(sum(total for _, total in needs.values()), GROUP_KEYS, tasks)
    sent = texts.filter("id is not null and text is not null").mapInArrow(
        _sketch_words(k_of_band, groups, length), "grp int, ids binary, sizes binary, counts binary, keys binary, more binary")
    found = written(sent.repartition(max(tasks, groups // 2), "grp").sortWithinPartitions("grp").mapInArrow(_pigeonholes(LISTED), "key long, a long, b long"), "pigeonholes")

    del sent
    release(spark)  # the keys are the largest shuffle

    whole = with_id.groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep"))
    member = with_id.join(whole, ["n", "fp1", "fp2"]).select("id", "rep")
    side = with_id.select("id", "n", "fp1", "fp2", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs."""
        x = side.select(*(F.col(c).alias(f"{o}_a") for c, o in zip(side.columns, ("id", "n", "p", "q", "s"))))
        y = side.select(*(F.col(c).alias(f"{o}_b") for c, o in zip(side.columns, ("id", "n", "p", "q", "s"))))
        close = pairs.join(x, pairs["a"] == x["id_a"]).join(y, pairs["b"] == y["id_b"])
        close = close.filter("3 * greatest(n_a, n_b) <= 4 * least(n_a, n_b) and not (n_a = n_b and p_a = p_b and q_a = q_b)")
        close = written(close.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_hamming, "a long, b long").distinct(), "close")
        release(spark)  # here and below: each step's shuffles go before the next one's are written
        ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
        sets = written(only_ids(texts, written(ids, "close-ids"), "id").mapInArrow(_shingle_rows(length), "id long, set binary"), "sets")
        release(spark)
        two = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        two = two.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        return written(two.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long"), "verified")

    links = verified(found.filter("key is null").select("a", "b").distinct())
    same = member.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    same = written(same, "same-sets")
    release(spark)
    groups_of = components(links.union(same))
    release(spark)

    # A linked pair has `margin` equal parts by its smaller document. Where fewer of them are crowded, another one has
    # listed the pair already; only the other documents are open.
    raised = [b for b, (level, _) in needs.items() if level > 0]
    # Equal sets have the same keys and are linked already: one of them stands for all under each key.
    crowd = found.filter("key is not null").select("key", F.col("a").alias("id")).join(member.distinct(), "id")
    crowd = written(crowd.select("key", F.col("rep").alias("id")).distinct(), "crowd-sets")
    release(spark)
    often = crowd.groupBy("id").agg(F.count("*").alias("crowded"))
    margin = with_id.groupBy("id").agg(F.min(F.when(F.col("band").isin(raised), 0).otherwise(F.col("margin"))).alias("margin"))
    state = often.join(margin, "id").join(groups_of, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"), (F.col("crowded") >= F.col("margin")).alias("open"))
    crowd = crowd.join(written(state, "crowd-state"), "id")
    open_keys = crowd.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c"), F.bool_or("open").alias("any"))
    open_keys = written(open_keys.filter("x < y and any").select("key", "x", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "crowded")
    # keys of one smallest component share most documents; in one task, up to a size, each of their pairs comes up once
    rows = F.sum(F.col("c") * F.col("blocks"))
    deals = pieces(open_keys.agg(rows).first()[0] or 0, TASK_ROWS)
    parts = open_keys.groupBy("x").agg(F.ceil(rows / TASK_ROWS).cast("int").alias("parts"))
    deal = F.pmod(F.xxhash64("x", F.pmod(F.hash("key"), "parts")), F.lit(deals))
    dealt = open_keys.join(parts, "x").select("key", "blocks", deal.alias("deal"))
    crowd = written(crowd.join(dealt, "key"), "crowd")
    release(spark)
    if crowd.count():
        near = crowd.join(with_id.select("id", "n", "sketch").distinct(), "id").withColumn("own", F.pmod(F.hash("id"), "blocks"))
        near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        near = near.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "component", "open", "sketch",
                           F.when(F.col("blocks") > 1, F.xxhash64("deal", "blocks", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("deal")).alias("deal"))
        near = near.repartition("deal").sortWithinPartitions("key", "i", "j").drop("deal")
        pairs = near.mapInArrow(_blocks, "a long, b long").distinct()
        pairs = written(pairs, "crowd-pairs")
        release(spark)
        links = links.union(verified(pairs))
        release(spark)
        groups_of = components(links.union(same))
    out = signed.select("id", F.col("n").alias("n_shingles"))
    return out.join(groups_of, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
