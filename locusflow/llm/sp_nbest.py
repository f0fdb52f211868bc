"""SentencePiece n-best encoding, and decoding.

A text's pieces form a lattice over its characters; a segmentation's score is the
sum of its pieces' scores. A forward Viterbi pass gives the best score up to each
character, and this is the exact heuristic of an A* search backward from the end:
complete segmentations leave the queue in the order of their scores.

No piece reaches over a pair of characters that no piece contains side by side,
so the lattice falls into parts at such pairs, and these are searched one by one.
The n best of a text change only the parts where a change costs least, n - 1 of
them at most: all parts get the forward pass, which also finds what the cheapest
change costs (remembered by word), those few get the search, and their
alternatives are merged exactly.

Characters without a piece are spelled in byte pieces at a fixed low score.
Decoding joins pieces and bytes and drops the blank put in front.

Defined cases: a null or empty text has no pieces, one segmentation and score 0;
fewer than n segmentations are given where there are no more; of equal scores the
search's own order decides, which depends on the part alone and then on the place;
rows are independent. A text's own ``▁`` is decoded as a blank.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BoundedCache

BLANK = "▁"
#: As far below the least piece as an unknown character is put.
UNKNOWN_PENALTY = 10.0

_BY_TOTAL = _SCORE = itemgetter(0)
_IDS, _GAP = itemgetter(1), itemgetter(2)
_models: dict[tuple[str, int], Segmenter] = {}


def _joined(parts: list[tuple[float, bytes, float]]) -> tuple[float, bytes, float]:
    return sum(map(_SCORE, parts)), b"".join(map(_IDS, parts)), min(map(_GAP, parts))


class Segmenter:
    """The n best segmentations of texts by a sentencepiece model's pieces and scores."""

    def __init__(self, path: str, n: int, cache: int = 500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (model.get_score(i), np.array([i], "<u4").tobytes()) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.spelled = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY
        self.spoken = [b""] * len(ids)
        for i in plain:
            self.spoken[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            self.spoken[i] = bytes([b])
        #: The pieces as a tree of characters: by character, what may follow, and score and ids if a piece ends there.
        self.tree: dict[str, list] = {}
        for p, own in self.pieces.items():
            follow = self.tree
            for char in p:
                node = follow.setdefault(char, [{}, None])
                follow = node[0]
            node[1] = own
        #: By character, those that stand after it in some piece.
        self.after: dict[str, set[str]] = {}
        for p in self.pieces:
            for a, b in zip(p, p[1:]):
                self.after.setdefault(a, set()).add(b)
        # words with the blanks before them, unless a piece has a blank after something else
        crossing = any(a != BLANK and BLANK in follow for a, follow in self.after.items())
        self.chunks = re.compile(".+" if crossing else f"{BLANK}+[^{BLANK}]*", re.DOTALL).findall
        self.n, self.cache = n, BoundedCache(cache)

    def spell(self, char: str) -> bytes:
        return np.array([self.bytes[b] for b in char.encode("utf-8", "surrogatepass")], "<u4").tobytes()

    def search(self, part: str) -> tuple[tuple[float, bytes], ...]:
        """The n best (score, ids) of a part, best first."""
        size, tree = len(part), self.tree
        best = [0.0] + [-np.inf] * size
        into: list[list[tuple[float, int, float, bytes]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            up_to, known, follow = best[i], False, tree
            for j in range(i + 1, size + 1):
                node = follow.get(part[j - 1])
                if node is None:
                    break
                follow, own = node
                if own is not None:
                    known = known or j == i + 1
                    score, ids = own
                    total = up_to + score
                    into[j].append((total, i, score, ids))
                    if total > best[j]:
                        best[j] = total
            if not known:
                total = up_to + self.spelled
                into[i + 1].append((total, i, self.spelled, self.spell(part[i])))
                best[i + 1] = max(best[i + 1], total)
        # An entry stands for the way into a place by its k-th best piece. Its score is exact, so
        # the way is followed to the start at once, and only each place's next best waits in the queue.
        found: list[tuple[float, bytes]] = []
        ordered = [False] * (size + 1)
        queue: list[tuple] = [(-best[size], size, 0, 0, 0.0, None)]
        made = 0
        while queue and len(found) < self.n:
            _, at, _, k, after, tail = heappop(queue)
            while at:
                ways = into[at]
                if not ordered[at]:
                    ways.sort(key=_BY_TOTAL, reverse=True)
                    ordered[at] = True
                if k + 1 < len(ways):
                    made += 1
                    heappush(queue, (-(ways[k + 1][0] + after), at, made, k + 1, after, tail))
                _, at, score, own = ways[k]
                after, tail, k = after + score, (own, tail), 0
            ids = []
            while tail is not None:
                own, tail = tail
                ids.append(own)
            found.append((after, b"".join(ids)))
        return tuple(found)

    def parts(self, marked: str) -> list[str]:
        """Cut where no piece reaches across."""
        after, none = self.after, ()
        cuts = [i for i, (a, b) in enumerate(zip(marked, marked[1:]), 1) if b not in after.get(a, none)]
        return [marked[i:j] for i, j in zip([0, *cuts], [*cuts, len(marked)])] if cuts else [marked]

    def scan(self, part: str) -> tuple[float, bytes, float]:
        """The Viterbi pass alone: the best score and ids, and how far below the second best is."""
        size, tree = len(part), self.tree
        first, second = [0.0] + [-np.inf] * size, [-np.inf] * (size + 1)
        back: list = [None] * (size + 1)
        for i in range(size):
            up_to, other, follow, j = first[i], second[i], tree, i
            for char in part[i:]:
                node = follow.get(char)
                if node is None:
                    break
                j += 1
                follow, own = node
                if own is not None:
                    score, ids = own
                    total = up_to + score
                    if total > first[j]:
                        rest = other + score
                        second[j] = first[j] if first[j] > rest else rest
                        first[j], back[j] = total, (i, ids)
                    elif total > second[j]:
                        second[j] = total
                if not follow:
                    break
            known = part[i] in tree and tree[part[i]][1] is not None
            if not known:
                total, j = up_to + self.spelled, i + 1
                if total > first[j]:
                    second[j] = max(first[j], other + self.spelled)
                    first[j], back[j] = total, (i, self.spell(part[i]))
                elif total > second[j]:
                    second[j] = total
        ids, at = [], size
        while at:
            at, own = back[at]
            ids.append(own)
        return first[size], b"".join(reversed(ids)), first[size] - second[size]

    def chunk(self, marked: str) -> tuple[float, bytes, float]:
        """scan() of a word with what stands at it, from its parts."""
        known = self.cache.old.get(marked)
        if known is None:
            known = self.scan(marked) if len(parts := self.parts(marked)) == 1 else _joined([self.part(p) for p in parts])
        return known

    def part(self, marked: str) -> tuple[float, bytes, float]:
        """scan() of a part, which may be a word of its own elsewhere."""
        known = self.cache.young.get(marked)
        if known is None:
            known = self.cache.young[marked] = self.cache.old.get(marked) or self.scan(marked)
        return known

    def best_of(self, marked: str) -> list[tuple[float, bytes]]:
        """The n best of a word with what stands at it."""
        lists = [self.search(p) for p in self.parts(marked)]
        gaps = sorted((p[0][0] - p[1][0], k) for k, p in enumerate(lists) if len(p) > 1)[: self.n - 1]
        return self.changed(sum(p[0][0] for p in lists), [p[0][1] for p in lists], [(k, lists[k]) for _, k in sorted(gaps, key=itemgetter(1))])

    def changed(self, total: float, ids: list[bytes], choices: list[tuple[int, list[tuple[float, bytes]]]]) -> list[tuple[float, bytes]]:
        """The n best that put alternatives in the places of choices."""
        ends = [-1, *(k for k, _ in choices), len(ids)]
        # what stays, before, between and after the places of choices, is joined once
        kept = [b"".join(ids[a + 1 : b]) for a, b in zip(ends, ends[1:])]
        queue, seen, out = [(0.0, (0,) * len(choices))], set(), []
        while queue and len(out) < self.n:
            lost, picks = heappop(queue)
            own = [x for stays, (_, ways), a in zip(kept, choices, picks) for x in (stays, ways[a][1])]
            out.append((total - lost, b"".join([*own, kept[-1]])))
            for place, (_, ways) in enumerate(choices):
                a = picks[place] + 1
                other = (*picks[:place], a, *picks[place + 1 :])
                if a < len(ways) and other not in seen:
                    seen.add(other)
                    heappush(queue, (lost + ways[a - 1][0] - ways[a][0], other))
        return out

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The n best (score, little-endian unsigned 32-bit ids) of a text, best first."""
        if not text:
            return [(0.0, b"")]
        chunks, known = self.chunks(BLANK + text.replace(" ", BLANK)), self.cache.young
        for c in set(chunks).difference(known):
            if c not in known:  # another word's part by now
                known[c] = self.chunk(c)
        found = [known[c] for c in chunks]
        gaps, cheap = list(map(_GAP, found)), []
        while len(cheap) < self.n - 1 and (least := min(gaps)) < np.inf:
            cheap.append(gaps.index(least))
            gaps[cheap[-1]] = np.inf
        cheap.sort()
        out = self.changed(sum(map(_SCORE, found)), list(map(_IDS, found)), [(k, self.best_of(chunks[k])) for k in cheap])
        self.cache.age()
        return out

    def decode(self, ids: bytes) -> str:
        spoken = self.spoken
        text = b"".join([spoken[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return text.decode("utf-8", "surrogatepass").removeprefix(" ")


def segmenter_at(path: str, n: int) -> Segmenter:
    """One per worker process, path and n."""
    if (path, n) not in _models:
        _models[path, n] = Segmenter(path, n)
    return _models[path, n]


def encode_nbest(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """docs with nbest: the n best segmentations, best first, as structs of score and ids (packed, 32 bits each)."""
    one = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.BinaryType())])

    @F.pandas_udf(T.ArrayType(one))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = segmenter_at(model_path, n)
        for texts in batches:
            yield pd.Series([[{"score": s, "ids": i} for s, i in model.encode(t or "")] for t in texts])

    return docs.withColumn("nbest", encode("text"))


def decode_ids(docs: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """docs with decoded, the text of the packed ids."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = segmenter_at(model_path, 1)
        for packed in batches:
            yield pd.Series([model.decode(i or b"") for i in packed])

    return docs.withColumn("decoded", decode(ids))


def segmentation_digests(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """doc_id, n_ids (of the best), scores and ids_crc32 (of the n best), decoded_ok; encodes and decodes every text in one pass."""
    fields = [("n_ids", T.LongType()), ("scores", T.ArrayType(T.DoubleType())), ("ids_crc32", T.ArrayType(T.LongType())), ("decoded_ok", T.BooleanType())]

    @F.pandas_udf(T.StructType([T.StructField(a, b) for a, b in fields]))
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = segmenter_at(model_path, n)
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                best = model.encode(t)
                rows.append((len(best[0][1]) // 4, [s for s, _ in best], [zlib.crc32(i) for _, i in best], model.decode(best[0][1]) == t.replace(BLANK, " ")))
            yield pd.DataFrame(rows, columns=[a for a, _ in fields])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
