"""Words and word sequences of Arrow text columns as 64-bit hashes, computed over whole batches with numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. Word hashes are differences of prefix sums of a polynomial over
random byte values, so one pass over the bytes of a batch serves every word in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20
#: The same where what a chunk sends shrinks with the repeats in it.
SENT_BYTES = 3 << 20
#: Bytes whose words are hashed at once; a longer single word is hashed alone.
HASHED_BYTES = 1 << 18
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_STEP = 0x9E3779B97F4A7C15 | 3
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_231)).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Rows handled at once where each becomes a dense vector of thousands of numbers.
CHUNK_ROWS = 512


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text and ``rows`` rows each, or one row."""
    for start, stop in _cuts(_sizes(batch, column), limit, rows):
        yield batch.slice(start, stop - start)


def sorted_chunks(batch: pa.RecordBatch, by: str, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Chunks of a batch in the order of ``by``; only the rows of one chunk are copied at a time."""
    order = pc.sort_indices(batch, sort_keys=[(by, "ascending")])
    for start, stop in _cuts(_sizes(batch, column)[order.to_numpy()], limit, batch.num_rows):
        yield batch.take(order.slice(start, stop - start))


def _sizes(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)


def _cuts(sizes: np.ndarray, limit: int, rows: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + limit, "right"))))
        yield start, stop
        start = stop


class Words:
    """Words of a text column: ``hashes`` in text order, those of row d at ``first[d]:first[d + 1]``.

    ``starts`` and ``ends`` are byte positions in ``data``, the UTF-8 bytes of all rows.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            data = table[data]
        word = (data != 32) & ((data < 9) | (data > 13))
        opens, closes = word.copy(), word.copy()
        inner = np.zeros(len(data) + 1, bool)
        inner[offsets] = True  # rows are never joined
        opens[1:] &= ~word[:-1] | inner[1:-1]
        closes[:-1] &= ~word[1:] | inner[1:-1]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.hashes = self._hashed()

    def _hashed(self) -> np.ndarray:
        """Hashes of all words, from the prefix sums of some whole words at a time: 16 bytes of sums and powers a byte of text."""
        out, values, up, down, lo = np.empty(len(self.starts), np.uint64), _byte_values(), None, None, 0
        while lo < len(out):
            begin = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, begin + HASHED_BYTES, "right")))
            starts, ends = self.starts[lo:hi] - begin, self.ends[lo:hi] - begin
            size = int(ends[-1])
            if up is None or len(up) < size:
                up, down = (powers(base, max(size, min(HASHED_BYTES, len(self.data)))) for base in (_STEP, pow(_STEP, -1, 2**64)))
            sums = np.zeros(size + 1, np.uint64)
            np.multiply(values[self.data[begin : begin + size]], up[:size], out=sums[1:])
            np.cumsum(sums, out=sums)
            length = (ends - starts).astype(np.uint64)
            out[lo:hi] = mix((sums[ends] - sums[starts]) * down[starts] + length * _MIX_2)
            lo = hi
        return out

    def runs(self, length: int, skip: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each word + ``skip``; only meaningful where they lie in one row."""
        n = len(self.hashes) - skip - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out, factor = np.zeros(n, np.uint64), 1
        for i in range(length):
            out += self.hashes[skip + i : skip + i + n] * np.uint64(factor)
            factor = factor * _STEP % 2**64
        return mix(out)

    def whole_runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of runs that lie in one row, and the row of each."""
        per_row = np.maximum(self.counts - length + 1, 0)
        rows = np.repeat(np.arange(len(per_row)), per_row)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + np.repeat(self.first[:-1], per_row)
        return at, rows


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each text, as longs; null: 0."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    word = (data != 32) & ((data < 9) | (data > 13))
    opens, edge = word.copy(), np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens[1:] &= ~word[:-1] | edge[1:-1]
    return np.diff(np.concatenate([[0], np.cumsum(opens)])[offsets])
