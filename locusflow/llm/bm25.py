"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND pruning.

Texts are read once into an index of documents (numbers of their terms, a 64-bit
hash each, and how often each occurs), which also gives the document frequencies
and the average length; so every shard scores with global statistics. A task
turns the documents it reads into shards: inverted indexes of a bounded number
of postings, a term's postings in document order, with the greatest addition in
each block of document numbers.

Queries don't move: they are cut into blocks of a bounded number of bytes, and
each block is broadcast to the tasks that read the index. A task keeps the k best
documents of each query over all its shards, and what it gives is merged exactly.

A block's search goes in rounds, each over three times as many documents as all
before; every document is in one round. What the rounds so far have found is the
first threshold of the next one (a score and a doc_id), so that the tasks of a
round give no more than about three times k documents a query together, however
many tasks there are.

Blocks are the same for all terms, so the cursors of a query's lists move from
border to border together, and the pivot is a block: the next one in which the
block maxima of the lists that have postings there add up to the threshold, the
k-th best score so far. Blocks before the pivot are skipped in all lists;
neighbouring pivots are scored at once.

Queries are documents ("more like this"): a query's terms are all distinct terms
of its whole text, each once. A caller may ask for the query_terms terms of
greatest tf * idf only (of equal ones those of the least hash).

Scores: sum over the query's terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b +
b * length / average length)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Terms
are added in the order of their hashes, so a score doesn't depend on the shard.

Defined cases: words are runs of letters and digits, lower-cased; a text without
words is found by no query and finds nothing; ties of score go to the least
doc_id, null last; repeated rows are documents of their own; queries that share
a doc_id (or have none) are one query with the terms of all.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, portions, release

K1, B = 1.2, 0.75
BLOCK = 256
#: Documents of a round in relation to all before it, less one; rounds at least.
GROWTH, ROUNDS = 4, 4
_WORD = re.compile(r"[^\W_]+").findall
_NO_ID = (1 << 63) - 1
INDEX = "doc_id long, length long, terms binary, tfs binary"
FOUND = "query_id long, doc_id long, score double"


def terms_of(text: str | None) -> Counter:
    return Counter(_WORD((text or "").lower()))


def _hashed(terms: Counter) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def build_index(docs: DataFrame) -> DataFrame:
    """One row per document with words: doc_id (the greatest long if null), length, and its terms' hashes in order with their counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                rows: list[tuple[int, int, bytes, bytes]] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts = terms_of(text)
                    if not counts:
                        continue
                    hashes, tfs = _hashed(counts), np.fromiter(counts.values(), np.uint32, len(counts))
                    order = np.argsort(hashes)
                    rows.append((_NO_ID if doc_id is None else doc_id, int(tfs.sum()), hashes[order].tobytes(), tfs[order].tobytes()))
                ids, lengths, terms, tfs = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "length", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX)


def document_frequencies(index: DataFrame, held: int = 1_000_000) -> DataFrame:
    """(term, df); a task adds up terms as long as it holds no more than so many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, dfs = np.empty(0, np.uint64), np.empty(0, np.int64)

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(dfs)], names=["term", "df"])

        for batch in batches:
            for part in portions(batch, 0, rows=4096, size=16 << 20):
                more = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64)
                both, where = np.unique(np.concatenate([terms, more]), return_inverse=True)
                dfs = np.bincount(where, np.concatenate([dfs, np.ones(len(more), np.int64)]), len(both)).astype(np.int64)
                terms = both
                if len(terms) > held:
                    yield given()
                    terms, dfs = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield given()

    return index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _unpacked(queries: DataFrame) -> DataFrame:
    """(query_id, term, tf) of index rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, size=1 << 20):
                terms = [np.frombuffer(t, np.int64) for t in part.column(1).to_pylist()]
                tfs = [np.frombuffer(t, np.uint32) for t in part.column(2).to_pylist()]
                ids = np.repeat(np.array(part.column(0).to_pylist(), np.int64), [len(t) for t in terms])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(terms)), pa.array(np.concatenate(tfs).astype(np.int64))], names=["query_id", "term", "tf"])

    return queries.select("doc_id", "terms", "tfs").mapInArrow(split, "query_id long, term long, tf long").groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))


class Shard:
    """An inverted index of documents: terms, their postings in document order, and block maxima."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, vocabulary: np.ndarray, idf: np.ndarray):
        """Postings in document order; terms that aren't in the vocabulary (sorted) are left out, the others are weighted by its idf."""
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        asked = vocabulary[at] == terms
        number, docs, impacts = at[asked], docs[asked], impacts[asked]
        order = np.argsort(number, kind="stable")
        self.blocks = -(-n_docs // BLOCK)
        self.docs, self.adds = docs[order], (impacts * idf[number])[order]
        self.numbers, first = np.unique(number[order], return_index=True)
        self.ends = np.append(first, len(order))
        # the most that a term adds in each block, by term and block
        cell = np.repeat(np.arange(len(self.numbers)), np.diff(self.ends)) * self.blocks + self.docs // BLOCK
        cells, begin = np.unique(cell, return_index=True)
        self.most = np.zeros((len(self.numbers), self.blocks), np.float32)
        if len(cells):
            self.most.ravel()[cells] = np.nextafter(np.maximum.reduceat(self.adds, begin).astype(np.float32), np.float32(np.inf))
        sizes = np.bincount(cell, minlength=len(self.numbers) * self.blocks).reshape(-1, self.blocks)
        self.starts = np.concatenate([np.zeros((len(self.numbers), 1), np.int64), np.cumsum(sizes, axis=1)], axis=1) + self.ends[:-1, None]

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What block_max_wand takes, for term numbers of the vocabulary in order."""
        at = np.searchsorted(self.numbers, numbers)
        at = at[(at < len(self.numbers)) & (self.numbers[np.minimum(at, len(self.numbers) - 1)] == numbers)] if len(self.numbers) else at[:0]
        return self.docs, self.adds, self.starts[at], self.most[at]


def block_max_wand(docs: np.ndarray, adds: np.ndarray, starts: np.ndarray, most: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers of a shard's k best documents of a score of floor at least, best first, equal scores by number.

    starts and most have a row for each list: where its blocks begin in docs and
    adds, and what is the most that a document of the block gets from it.
    """
    best, where = np.empty(0), np.empty(0, np.int64)
    if not len(starts):
        return best, where
    # sums of single-precision maxima, a little above what they round
    bounds = most.sum(axis=0, dtype=np.float64) * (1 + 1e-9)
    at, blocks = 0, len(bounds)
    reach = blocks if floor > 0 else 1
    while at < blocks:
        # the pivot: the first block from the cursors on whose bound reaches the threshold
        live = bounds[at : at + reach] >= floor
        live &= bounds[at : at + reach] > 0
        pivots = np.flatnonzero(live)
        if len(pivots):
            first = at + int(pivots[0])
            stop = np.flatnonzero(~live[pivots[0] :])
            last = first + int(stop[0]) if len(stop) else at + len(live)
            spans = list(zip(starts[:, first].tolist(), starts[:, last].tolist(), strict=True))
            scores = np.bincount(np.concatenate([docs[i:j] for i, j in spans]) - first * BLOCK, np.concatenate([adds[i:j] for i, j in spans]))
            hit = np.flatnonzero((scores >= floor) & (scores > 0))
            if len(hit) > k:
                least = np.partition(scores[hit], -k)[-k]
                hit = hit[scores[hit] >= least]
            best, where = np.concatenate([best, scores[hit]]), np.concatenate([where, hit + first * BLOCK])
            top = np.lexsort((where, -best))[:k]
            best, where = best[top], where[top]
            if len(best) == k:
                floor = max(floor, float(best[-1]))
            at = last
        else:
            at += len(live)
        reach = blocks
    return best, where


class Asked:
    """A block of queries: their ids, and terms as numbers of one vocabulary."""

    def __init__(self, ids: list[int], terms: list[bytes], idfs: list[bytes]):
        hashes, weights = (np.frombuffer(b"".join(x), t) for x, t in ((terms, np.uint64), (idfs, np.float64)))
        self.ids = np.array(ids, np.int64)
        self.vocabulary, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        self.idf = weights[first]
        ends = np.cumsum([0, *(len(t) // 8 for t in terms)])
        where = where.astype(np.uint32)
        self.terms = [np.sort(where[i:j]) for i, j in zip(ends, ends[1:])]


def _evaluated(index: DataFrame, asked: Broadcast[Asked], floors: dict[int, tuple[float, int]], average: float, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """The k best of each query in each task's documents, as far as they come before the query's floor (score and doc_id)."""
    known = index.sparkSession.sparkContext.broadcast(floors)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asked.value
        least = [known.value.get(i, (0.0, _NO_ID)) for i in own.ids.tolist()]
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(own.ids)
        held: list[tuple[int, int, bytes, bytes]] = []
        size = 0

        def search() -> None:
            """All queries over the shard of the documents held, numbered by doc_id."""
            held.sort(key=lambda r: r[0])
            ids = np.array([r[0] for r in held], np.int64)
            counts = [len(r[2]) // 8 for r in held]
            tf = np.frombuffer(b"".join(r[3] for r in held), np.uint32).astype(float)
            norm = np.repeat(K1 * (1 - B + B * np.array([r[1] for r in held], float) / average), counts)
            docs = np.repeat(np.arange(len(held)), counts)
            shard = Shard(np.frombuffer(b"".join(r[2] for r in held), np.uint64), docs, tf * (K1 + 1) / (tf + norm), len(held), own.vocabulary, own.idf)
            for q, numbers in enumerate(own.terms):
                floor, last = least[q]
                scores, where = block_max_wand(*shard.lists(numbers), k, floor)
                found = ids[where]
                before = (scores > floor) | (found < last)
                if before.any():
                    scores, found = np.concatenate([top[q][0], scores[before]]), np.concatenate([top[q][1], found[before]])
                    order = np.lexsort((found, -scores))[:k]
                    top[q] = scores[order], found[order]
                    if len(order) == k:
                        least[q] = float(top[q][0][-1]), int(top[q][1][-1])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[2]) // 8
                if len(held) >= shard_docs or size >= shard_postings:
                    search()
                    held, size = [], 0
        if held:
            search()
        n = [len(scores) for scores, _ in top]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.ids, n)), pa.array(np.concatenate([d for _, d in top])), pa.array(np.concatenate([s for s, _ in top]))], names=["query_id", "doc_id", "score"])

    return index.mapInArrow(evaluate, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame | Column, k: int = 10, query_terms: int | None = None, shard_docs: int = 8192, shard_postings: int = 2_000_000, block_mb: float = 32) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents of each query.

    queries: rows of doc_id and text, or a condition on doc_id for the rows of
    docs that are queries. All distinct terms of a query's text count, unless
    query_terms is given. block_mb: bytes of queries that are broadcast at once,
    about.
    """
    spark = docs.sparkSession
    n = docs.count()
    # the first round has a shard's documents, or fewer
    rounds = max(ROUNDS, 1 + math.ceil(math.log(max(n, 1) / shard_docs, GROWTH)))
    place = F.pmod(F.xxhash64("doc_id", "length"), F.lit(GROWTH ** (rounds - 1)))
    turn = sum(((place >= GROWTH**i).cast("int") for i in range(rounds - 1)), F.lit(0))
    index = materialise(build_index(docs).withColumn("round", turn), "bm25-index", by="round")
    whole = index.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).first()
    average = (whole.length or 0) / max(n, 1) or 1.0
    own_id = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id")
    asked = index.select(own_id, "terms", "tfs").where(queries) if isinstance(queries, Column) else build_index(queries)
    asked = _unpacked(asked.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID))))

    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(document_frequencies(index).select("term", idf.alias("idf")), "term")
    if query_terms is not None:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("tf") * F.col("idf")), "term"))
        weighted = weighted.withColumn("nth", nth).where(F.col("nth") <= query_terms)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, np.int64).tobytes() for x in lists[1]]), pa.array([np.array(x, float).tobytes() for x in lists[2]])], names=["query_id", "terms", "idfs"])

    listed = weighted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("all"))
    packed = materialise(listed.select("query_id", "all.term", "all.idf").mapInArrow(pack, "query_id long, terms binary, idfs binary"), "bm25-queries")
    size = packed.agg(F.sum(F.length("terms") + F.length("idfs"))).first()[0] or 0
    blocks = max(1, math.ceil(size / (block_mb * (1 << 20))))
    dealt = packed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    parts: list[DataFrame] = []
    for block in range(blocks):  # each is of a bounded size, and a search over all documents
        rows = sorted(tuple(r) for r in dealt.where(F.col("block") == block).drop("block").collect())
        if not rows:
            continue
        ids, terms, idfs = (list(x) for x in zip(*rows, strict=True))
        asked_now = spark.sparkContext.broadcast(Asked(ids, terms, idfs))
        found: DataFrame | None = None
        for turn in range(rounds):
            floors = {r.query_id: (r.score, r.doc_id) for r in _best(found, k).where(F.col("rank") == k).collect()} if found is not None else {}
            docs_now = n * (GROWTH - 1 if turn else 1) / GROWTH ** (rounds - max(turn, 1))
            searched = index.where(F.col("round") == turn).drop("round").coalesce(max(1, math.ceil(docs_now / shard_docs)))
            part = materialise(_evaluated(searched, asked_now, floors, average, k, shard_docs, shard_postings), "bm25-found")
            found = part if found is None else found.unionByName(part)
        asked_now.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    release(index)
    found = functools.reduce(DataFrame.unionByName, parts)
    missing = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return _best(found, k).select(missing("query_id"), "rank", missing("doc_id"), "score")
