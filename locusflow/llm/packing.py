"""Sequence packing by minimum bin slack.

Documents are tokenised once and cut at the capacity: full windows stand alone,
what remains of a document is shorter than a window. How those remainders are
packed depends only on how many there are of each length, so the plan is made
from a histogram of at most capacity - 1 counts: a bitset subset-sum over the
lengths that are left finds the multiset that fills a window closest to its
capacity (a Python integer is the bitset, and the bitsets after each length are
kept so that the counts can be traced back); the pattern is then repeated as
often as the counts allow. A pattern uses up at least one length each time, so
the plan has at most capacity patterns at any size of the input.

Remainders get their place by their rank within their length. Ranks are counted
per (length, salt), so a length that holds a third of all rows is spread out.

Defined cases: a null or empty text is the end-of-text id alone; repeated rows
are packed each by itself; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, batches_of, materialise, spread

CAPACITY = 2048
#: Rows that are tokenised at a time.
ROWS = 256
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

_tokenizers: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer:
    """The tokenizer's ids of a text, remembering those of chunks between white space and of their words.

    The vocabulary's pre-tokenizer drops white space and its pieces never cross
    it, so a text's ids are those of its chunks, one after the other. Texts with
    characters whose case folding, composition or class is not plain go to the
    tokenizer whole.
    """

    _LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-į"
    _DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"

    def __init__(self, path: str, cache: int = 200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.plain = re.compile("[\t\n\r\x20-\x7e\xa1-į]*").fullmatch
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{self._LETTERS}]+|[{self._DIGITS}]|[^\s{self._LETTERS}{self._DIGITS}]+").findall
        pre = self.whole.pre_tokenizer
        self.bytes = {c: "".join(s for s, _ in pre.pre_tokenize_str(chr(c))) for c in range(0x21, 0x130) if not chr(c).isspace()}
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.known = BoundedCache(cache)

    def _word(self, word: str) -> bytes:
        ids = self.known.young.get(word)
        if ids is None:
            ids = self.known.old.get(word)
            if ids is None:
                ids = b"".join([self.packed[t.id] for t in self.model.tokenize(word.translate(self.bytes))])
            self.known.young[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = self.known.old.get(chunk)
        return b"".join(map(self._word, self.parts(chunk))) if ids is None else ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks, known = text.lower().split(), self.known.young
        for chunk in set(chunks).difference(known):
            known[chunk] = self._chunk(chunk)
        out = b"".join(map(known.__getitem__, chunks))
        self.known.age()
        return out


def tokenizer_at(path: str) -> ChunkTokenizer:
    """One per worker process and path."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document's ids: full windows, then what remains."""
    tail, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_at(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tokens.ids(text or "") + tail
                    for start in range(0, len(ids), width):
                        piece = ids[start : start + width]
                        for column, x in zip(rows, (doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:5]), pa.array(rows[5], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Pattern:
    """lengths: (length, count) pairs, longest first; windows: how often it is used."""

    lengths: tuple[tuple[int, int], ...]
    windows: int


def fullest(counts: dict[int, int], capacity: int) -> tuple[tuple[int, int], ...]:
    """The multiset with the longest length that fills a window closest to its capacity."""
    order = sorted((n for n, c in counts.items() if c), reverse=True)
    first = order[0]
    room = capacity - first
    mask, reach = (1 << (room + 1)) - 1, 1
    before: list[tuple[int, int, int]] = []
    for length in order:
        most = min(counts[length] - (length == first), room // length)
        if most <= 0:
            continue
        before.append((length, most, reach))
        left, step = most, 1
        while left and not reach >> room & 1:  # counts by doubling: 1, 2, 4, ... copies
            take = min(step, left)
            reach |= reach << take * length & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {first: 1}
    for length, most, had in reversed(before):
        for k in range(most + 1):
            if total >= k * length and had >> (total - k * length) & 1:
                break
        if k:
            used[length] = used.get(length, 0) + k
            total -= k * length
    return tuple(sorted(used.items(), reverse=True))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up all counts, each as often as the counts allow."""
    left, patterns = dict(counts), []
    while left:
        lengths = fullest(left, capacity)
        windows = min(left[n] // c for n, c in lengths)
        patterns.append(Pattern(lengths, windows))
        for n, c in lengths:
            left[n] -= c * windows
            if not left[n]:
                del left[n]
    return patterns


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, salts: int | None = None) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there.

    ids (binary, little-endian unsigned 32-bit) is null unless with_ids.
    salts: parts that a length's rows are dealt into, eight for each shuffle partition by default.
    """
    spark = docs.sparkSession
    salts = salts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batches_of(spark, ROWS):
        pieces = materialise(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pack")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # at most capacity * salts rows
    table = sorted((r.length, r.salt, r.n) for r in sizes.collect())
    counts: dict[int, int] = {}
    offsets = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in table:
        offsets[length, salt] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    full = counts.pop(capacity, 0)

    # by length: first rank of each slot, and the slot's pieces a window, first sequence and first offset
    slots: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {capacity: ([0], [(1, 0, 0)])}
    taken: dict[int, int] = {}
    sequence = full
    for pattern in plan(counts, capacity):
        at = 0
        for length, k in pattern.lengths:
            firsts, places = slots.setdefault(length, ([], []))
            firsts.append(taken.get(length, 0))
            places.append((k, sequence, at))
            taken[length] = taken.get(length, 0) + k * pattern.windows
            at += k * length
        sequence += pattern.windows
    shared = spark.sparkContext.broadcast((offsets, slots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, where = shared.value
        last, rank = None, 0
        for batch in batches:
            lengths, salted = batch.column("length").to_pylist(), batch.column("salt").to_pylist()
            sequences, starts = [], []
            for length, salt in zip(lengths, salted, strict=True):
                rank = rank + 1 if last == (length, salt) else 0
                last = (length, salt)
                firsts, places = where[length]
                r = int(base[length, salt]) + rank
                slot = bisect_right(firsts, r) - 1
                k, first, at = places[slot]
                nth = r - firsts[slot]
                sequences.append(first + nth // k)
                starts.append(at + nth % k * length)
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequences, pa.int64()), pa.array(starts, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"])

    dealt = spread(pieces, "salt").sortWithinPartitions("length", "salt", "doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
