"""Packing by minimum bin slack.

A document's token ids are cut into full windows and a rest, so all that packing needs to know is how many
rests of each length there are: a table of at most ``capacity`` counts, whatever the size of the corpus. For
each window the multiset of remaining lengths that fills it closest to its capacity is found by subset-sum
dynamic programming over a bitset of reachable sums, the longest length first; walking back through the bitsets gives
how many of each length it takes. The multiset is used for as many windows as the counts allow. Where no
multiset fills a window, the longest length left is cut, and its tail goes back to the counts. What is left
below a full window fills windows of powers of two, which are not padded.

Spark does the rest: documents are tokenised where they lie, their pieces get gapless ranks among the pieces of their
length from counts per task and length, and a piece finds its window by length and rank.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.llm.store import only_ids, written
from harvestry.llm.words import chunks

#: Ids of one window.
CAPACITY = 4096
#: Bytes of text tokenised at once, and words beyond which a Python worker forgets ids.
TEXT_BYTES = 8 << 20
KNOWN_WORDS = 300_000
#: Letters and marks of plain words, which are a stretch of letters and perhaps one of marks, and how many stretches of
#: letters are tokenised as one text. The apostrophe is no mark here: with letters behind it, it can be a stretch.
LETTERS, MARKS, TOGETHER = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~", 100
PLAIN, STRETCH = f"^(?P<head>[{LETTERS}]+)(?P<tail>[{MARKS}]*)$", re.compile(f"[{LETTERS}]+")
#: How tokens at the end of a stretch are written in a vocabulary that marks word ends.
WORD_END = "</w>"
#: Pieces of one length that a rank can tell apart.
_RANKS = 40


def _of(characters: str) -> str:
    return "".join(c for c in map(chr, range(256)) if re.match(f"[{characters}]", c))


class TextIds:
    """Token ids of whole texts. Where the tokenizer drops white space, each distinct word of a batch is tokenised once.

    No step of such a tokenizer reaches across white space, so the ids of a text are those of its words in turn; tests
    compare them with the tokenizer's own. Where it also parts letters from marks, plain words are looked up as a head of
    letters and a tail of marks, in small letters if it makes all letters small: "House", "house," and "house" are
    tokenised once. Other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        both = self._encode(["one two.", "one", "two.", "\tone\n\n two. "])
        self.by_word = both[0] == both[1] + both[2] == both[3] and self.ends[both[0]].sum() == 3
        self.by_part = self.by_word and self._parts()
        normal, letters = self.tokenizer.normalizer, _of(LETTERS)
        self.small = normal is not None and normal.normalize_str(letters) == letters.lower()
        self.place: dict[str, int] = {}
        self.ids, self.sizes, self.again = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self) -> bool:
        """Whether the ids of a plain word are those of its letters and those of its marks."""
        letters, marks = _of(LETTERS), _of(MARKS)
        heads, tails = self._encode(list(letters)), self._encode(list(marks))
        return (
            self._encode([a + m for a in letters for m in marks]) == [a + m for a in heads for m in tails]
            and all(self.ends[a].sum() == 1 for a in heads)
            # a token that is found in the text itself must not lie within a plain word
            and not any(re.fullmatch(f"[{LETTERS}]*[{MARKS}]*", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))

    def _forget(self) -> None:
        """Words that came up again since the last time are kept, unless they are too many."""
        kept, words = np.flatnonzero(self.again), list(self.place)  # in the order of their places
        if len(kept) > KNOWN_WORDS // 2:
            kept = kept[:0]
        self.place = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.ids, self.sizes, self.again = _in_turn(self.ids, self.sizes, kept), self.sizes[kept], np.zeros(len(kept), bool)

    def _learn(self, words: list[str]) -> None:
        # many stretches in one text cost less than a text each; where one ends is seen by its tokens
        plain, odd = [], []
        for w in words:
            (plain if self.by_part and STRETCH.fullmatch(w) else odd).append(w)
        texts = [" ".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
        joined = np.array([i for ids in self._encode(texts) for i in ids], np.uint32)
        single = self._encode(odd)
        self.place.update(zip(plain + odd, range(len(self.sizes), len(self.sizes) + len(words))))
        self.ids = np.concatenate([self.ids, joined, np.array([i for ids in single for i in ids], np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.diff(np.flatnonzero(self.ends[joined]), prepend=-1), np.array([len(ids) for ids in single], np.int64)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each of these are in ``sizes``; new ones are learned."""
        found = words.dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False)
        if len(self.place) > KNOWN_WORDS:
            self._forget()
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = place < 0
        self.again[place[~new]] = True
        if new.any():
            self._learn(words[new].tolist())
            place[new] = [self.place[w] for w in words[new]]
        return place[found.indices.to_numpy()]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in turn and how many each has."""
        if not self.by_part:
            place = self._places(words)
            return _in_turn(self.ids, self.sizes, place), self.sizes[place]
        plain = pc.extract_regex(words, PLAIN)
        head, tail = pc.struct_field(plain, "head"), pc.struct_field(plain, "tail")
        head = pc.coalesce(pc.utf8_lower(head) if self.small else head, words)
        place = self._places(pa.concat_arrays([head, pc.fill_null(tail, "")])).reshape(2, -1).T
        return _in_turn(self.ids, self.sizes, place.ravel()), self.sizes[place].sum(1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end among them."""
        if not self.by_word:
            found = self._encode(pc.fill_null(texts, "").to_pylist())
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum([0, *map(len, found)])
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        found = lists.flatten().dictionary_encode()
        word = found.indices.to_numpy()
        ids, sizes = self._words(found.dictionary)
        cuts = np.concatenate([[0], np.cumsum(sizes[word])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return _in_turn(ids, sizes, word), cuts


def _in_turn(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Ids of the stretches ``which``, in turn; ``ids`` has all stretches one after the other, ``sizes`` how long each is."""
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(ids))
    return lists.take(pa.array(which)).flatten().to_numpy()


@lru_cache(maxsize=1)
def _text_ids(path: str, changed: int) -> TextIds:
    return TextIds(path)


def text_ids(path: str) -> TextIds:
    """The ids by the file at ``path``; a Python worker keeps the file and the words it knows from task to task."""
    return _text_ids(path, os.stat(path).st_mtime_ns)


def best_filling(window: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many of each length make up the multiset with the largest sum of at most ``window``.

    ``lengths`` are those with a count, ascending. The longest that fits is always in. Of several best ones, the
    one of longer lengths is taken.
    """
    fitting = bisect_left(lengths, window + 1)
    if not fitting:
        return {}
    longest = lengths[fitting - 1]
    mask = (1 << (window + 1)) - 1
    reach, steps = 1 << longest, []
    for length in reversed(lengths[:fitting]):
        if reach >> window:
            break
        left, chunk = min(counts[length] - (length == longest), (window - longest) // length), 1
        while left > 0 and not reach >> window:
            some = min(chunk, left)
            after = reach | ((reach << (some * length)) & mask)
            if after != reach:
                steps.append((length, some, reach))
                reach = after
            left, chunk = left - some, 2 * chunk
    rest, out = reach.bit_length() - 1, Counter({longest: 1})
    for length, some, before in reversed(steps):
        if not before >> rest & 1:  # only with these is this sum reached
            out[length] += some
            rest -= some * length
    return dict(out)


class Plan:
    """Windows over the counts of lengths: which ranks of a length go where.

    ``rows``: length of the piece, first of its ranks and their number, where in the piece a part starts and its
    length, place of the first rank among all that are dealt with it, how many go into each window, first
    window, and offset there.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.counts = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)
        self.runs = {length: deque([(length, 0, n, 0)]) for length, n in self.counts.items()}
        self.found: list[tuple[int, ...]] = []
        self.windows = 0
        full, rest = divmod(sum(length * n for length, n in self.counts.items()), capacity)
        self._fill(capacity, full)
        for bit in reversed(range(capacity.bit_length())):
            if rest >> bit & 1:
                self._fill(1 << bit, 1)
        self.rows = np.array(self.found, np.int64).reshape(-1, 9)

    def _fill(self, window: int, many: int) -> None:
        while many:
            chosen = best_filling(window, self.lengths, self.counts)
            slack = window - sum(length * n for length, n in chosen.items())
            need = Counter(chosen)
            if slack:
                # a length that is left and were no longer than the slack would be in the multiset
                cut = next(x for x in reversed(self.lengths) if self.counts[x] > chosen.get(x, 0))
                need[cut] += 1
            times = min(many, *(self.counts[length] // n for length, n in need.items()))
            offset = 0
            for length, n in chosen.items():
                self._deal(self._taken(length, n * times), length, n, offset)
                offset += length * n
            if slack:
                parts = self._taken(cut, times)
                self._deal(parts, slack, 1, offset)
                for origin, rank, n, start in parts:
                    self._give(cut - slack, (origin, rank, n, start + slack))
            self.windows += times
            many -= times

    def _taken(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        runs, out = self.runs[length], []
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        while n:
            origin, rank, held, start = runs.popleft()
            out.append((origin, rank, min(n, held), start))
            if held > n:
                runs.appendleft((origin, rank + n, held - n, start))
            n -= out[-1][2]
        return out

    def _give(self, length: int, run: tuple[int, int, int, int]) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
        self.counts[length] = self.counts.get(length, 0) + run[2]
        self.runs.setdefault(length, deque()).append(run)

    def _deal(self, runs: list[tuple[int, int, int, int]], length: int, each: int, offset: int) -> None:
        place = 0
        for origin, rank, n, start in runs:
            self.found.append((origin, rank, n, start, length, place, each, self.windows, offset))
            place += n


def _pieces(path: str, capacity: int, end_id: int):
    """Full windows and the rest of each document, each with its rank among those of its length in this task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, task = text_ids(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                ids, cuts = ids_of(part.column("text"))
                tokens = np.diff(cuts) + 1
                each = -(-tokens // capacity)
                doc = np.repeat(np.arange(part.num_rows), each)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = number * capacity
                length = np.minimum(tokens[doc] - start, capacity)
                raw, end = ids.astype("<u4").tobytes(), np.array([end_id], "<u4").tobytes()
                crc = np.empty(len(doc), np.int64)
                for i, (d, s, n) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist())):
                    at = 4 * (int(cuts[d]) + s)
                    last = s + n == tokens[d]
                    value = zlib.crc32(raw[at : at + 4 * (n - last)])
                    crc[i] = zlib.crc32(end, value) if last else value
                order = np.argsort(length, kind="stable")
                group = length[order]
                first = np.flatnonzero(np.diff(group, prepend=-1))
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(first, np.diff(first, append=len(doc))) + seen[group]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(doc)) for c in ("id", "text_key", "text_key_2")), pa.array(start), pa.array(length), pa.array(crc),
                     pa.array(tokens[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)],
                    ["id", "text_key", "text_key_2", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])

    return cut


def _place(rows: np.ndarray, capacity: int):
    """Window and offset of each piece; a piece that is cut gives a row for each part, in turn from its start."""

    def key(length, start, rank):
        return ((length * (capacity + 1) + start) << _RANKS) | rank

    order = np.argsort(key(*rows[:, [0, 3, 1]].T), kind="stable")
    origin, first, many, begin, size, place, each, sequence, offset = rows[order].T
    keys = key(origin, begin, first)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            row, done = np.arange(len(length)), np.zeros(len(length), np.int64)
            while len(row):
                at = np.searchsorted(keys, key(length[row], done, rank[row]), "right") - 1
                dealt = place[at] + rank[row] - first[at]
                columns = {c: batch.column(c).take(pa.array(row)) for c in ("id", "text_key", "text_key_2", "ids_crc32", "doc_tokens")}
                columns |= {"start": pa.array(start[row] + done), "length": pa.array(size[at]), "sequence_id": pa.array(sequence[at] + dealt // each[at]),
                            "offset": pa.array(offset[at] + dealt % each[at] * size[at]), "whole": pa.array(size[at] == length[row])}
                yield pa.RecordBatch.from_pydict(columns)
                done = done + size[at]
                more = done < length[row]
                row, done = row[more], done[more]

    return find


_PLACED = "id long, text_key long, text_key_2 long, ids_crc32 long, doc_tokens long, start long, length long, sequence_id long, offset long, whole boolean"


def _checksums(path: str, end_id: int):
    """Checksum of the ids of one part of each text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(path)
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                ids, cuts = ids_of(part.column("text"))
                crc = []
                for d, (start, length) in enumerate(zip(part.column("start").to_pylist(), part.column("length").to_pylist())):
                    own = np.append(ids[cuts[d] : cuts[d + 1]], np.uint32(end_id))[start : start + length]
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("text_key", "text_key_2", "start", "length")), pa.array(crc, pa.int64())],
                    ["text_key", "text_key_2", "start", "length", "part_crc32"])

    return sums


def pack_windows(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2,
) -> DataFrame:
    """``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``: one row per piece of a document.

    A document is its ids by the tokenizer file at ``tokenizer`` (a path that every executor has) and ``end_id``; null,
    empty and blank texts are ``end_id`` alone. ``capacity`` is a power of two. Every sequence but the last few holds
    ``capacity`` ids; those hold a power of two each, so nothing is padded. Sequences are numbered without gaps, the
    fullest first. Rows without an id and repeated rows are packed like others; a very long text gives many pieces. Pieces
    of equal length are interchangeable: which goes where depends on the order the rows are read in. Extra columns play no
    part. An empty table gives an empty result.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(1), text).alias("text_key_2")]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *keys, text.alias("text"))
    pieces = written(texts.mapInArrow(
        _pieces(tokenizer, capacity, end_id),
        "id long, text_key long, text_key_2 long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"), "pieces")
    per_task = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = Plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base.hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = written(ranked.mapInArrow(_place(plan.rows, capacity), _PLACED), "placed")
    out = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # few pieces are cut; the ids of those are looked at again
    spec = ["text_key", "text_key_2", "start", "length"]
    cut = placed.filter("not whole")
    parts = written(cut.select(*spec).distinct(), "cut")
    if not parts.limit(1).count():
        return placed.select(*out)
    wanted = written(parts.select("text_key", "text_key_2").distinct(), "cut-texts")
    again = only_ids(texts.drop("id"), wanted, ["text_key", "text_key_2"]).dropDuplicates(["text_key", "text_key_2"])
    sums = written(parts.join(again, ["text_key", "text_key_2"]).mapInArrow(
        _checksums(tokenizer, end_id), "text_key long, text_key_2 long, start long, length long, part_crc32 long"), "cut-sums")
    mended = cut.join(sums, spec).withColumn("ids_crc32", F.col("part_crc32"))
    return placed.filter("whole").select(*out).unionByName(mended.select(*out))
