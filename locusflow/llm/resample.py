"""Importance resampling towards a target distribution, over hashed word features.

Identical texts are collapsed by grouping the full text: features are computed
once for each text, and what they add to the corpus counts is multiplied by the
text's copies. A feature's bucket is its crc32 modulo the number of buckets; the
buckets' log ratios between target and corpus are the gains, and a text's weight is
the mean of its features' gains. Weights are joined back to the documents by the
text's SHA-256, and only then noise that belongs to the document (a Gumbel variable
from its doc_id) is added: the highest sums are a draw without replacement.

Scale: a text's features are kept as two bytes each, so texts are read and shuffled
once. Texts with so many copies that their key would fill a task of the join
(at most _HOT of them, whatever the corpus holds) are broadcast instead. The
drawn share is found by a histogram of the scores, which are thousandths of
logarithms (about 100 000 values at most); ranks are numbered within range
partitions.

Defined cases: a null or empty text has no features and weight 0; a null doc_id
makes noise from an empty string and comes last among ties; rows that repeat a doc_id
are documents each, ties among them go by weight and n_features; an empty table
gives an empty table. An empty target has no counts: gains are then those of the
corpus against nothing. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, in_ranges, light, materialise, portions, running_totals, text_of

BUCKETS = 10_000
_HOT = SMALL
_HOT_COPIES = 1024
#: Every byte that is no part of a word becomes a space; A-Z are lower-cased, bytes of other scripts stay.
_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_CACHED, _CACHED_BYTES = 1 << 19, 48


class _Buckets(dict):
    """The buckets of features; short ones are remembered, so its size is bounded."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= _CACHED_BYTES:
            if len(self) >= _CACHED:
                self.clear()
            self[feature] = bucket
        return bucket


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, of UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


def runs_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to longest consecutive words."""
    runs = list(words)
    for n in range(2, longest + 1):
        runs.extend(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return runs


def text_features(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(text, copies) as (text_key, copies, n_words, n_features, features): the buckets as packed unsigned integers."""
    kind = _kind(buckets)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            for part in portions(batch, 0):
                n_words, n_features, packed = [], [], []
                for text in part.column(0).cast(pa.binary()).to_pylist():
                    words = words_of(text)
                    runs = runs_of(words, longest)
                    n_words.append(len(words))
                    n_features.append(len(runs))
                    packed.append(np.fromiter(map(known.__getitem__, runs), kind, len(runs)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())], names=["text_key", "copies", "n_words", "n_features", "features"])

    keyed = texts.select("text", text_key(F.col("text")).alias("text_key"), "copies")
    return keyed.mapInArrow(hashed, "text_key binary, copies long, n_words long, n_features long, features binary")


def text_key(text: Column) -> Column:
    """The SHA-256 of a text, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the corpus, copies counted."""
    kind = _kind(buckets)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, times = np.unique(np.frombuffer(packed, kind), return_counts=True)
                counts[own] += times * copies
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["bucket", "n"])

    merged = features.select("copies", "features").mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in merged.collect():  # one row a bucket at most
        counts[row.bucket] = row.n
    return counts


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share of the target over that of the corpus, floored."""
    t, s, n = target.astype(np.float64), corpus.astype(np.float64), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """features with weight, the floored mean of the features' gains, in place of the features."""
    shared = features.sparkSession.sparkContext.broadcast(gains)
    kind = _kind(len(gains))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            sums = [int(gain[np.frombuffer(x, kind)].sum()) // max(len(x) // kind.itemsize, 1) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["text_key", "copies", "n_words", "n_features", "weight"])

    return features.mapInArrow(weigh, "text_key binary, copies long, n_words long, n_features long, weight long")


def collapsed(docs: DataFrame) -> DataFrame:
    """(text, copies): each text once."""
    return docs.groupBy(text_of().alias("text")).agg(F.count(F.lit(1)).alias("copies"))


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable, floored, from the first 32 bits of a document's hash."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document of docs; rank is null where it isn't drawn.

    floor(percent * N / 100) of the N documents with at least min_words words are drawn, highest score first.
    """
    features = materialise(text_features(collapsed(docs), buckets, longest), "resample-features")
    gains = bucket_gains(bucket_counts(text_features(collapsed(target), buckets, longest), buckets), bucket_counts(features, buckets))
    weights = materialise(text_weights(features, gains), "resample-weights")
    rows = weights.agg(F.sum("copies")).first()[0] or 0

    # texts with more copies than this are _HOT at most
    many = max(_HOT_COPIES, rows // _HOT + 1)
    of_text = ["text_key", "n_words", "n_features", "weight"]
    hot = weights.where(F.col("copies") >= many).select(*of_text)
    rest = weights.where(F.col("copies") < many).select(*of_text)
    keyed = docs.select(F.col("doc_id"), text_key(text_of()).alias("text_key"))
    met = keyed.join(F.broadcast(hot), "text_key", "left")
    cold = met.where("weight IS NULL").select("doc_id", "text_key").join(rest, "text_key")
    both = met.where("weight IS NOT NULL").unionByName(cold)
    scored = both.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("row"))
    scored = materialise(scored, "resample-scored")

    drawn, least = drawn_share(scored.where(F.col("n_words") >= min_words), percent)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.asc("row")]
    may = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    high = running_totals(in_ranges(scored.where(may).withColumn("one", F.lit(1)), "resample-ranges", *order), "one", "before", order)
    ranked = high.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    others = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(others.select(*columns))


def drawn_share(scored: DataFrame, percent: int) -> tuple[int, int]:
    """How many documents are drawn, and the least score among them."""
    # scores are thousandths of logarithms of counts and of 32-bit shares: a row for each value is a bounded table
    table = sorted(((r.score, r.n) for r in scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in table) // 100
    left = drawn
    for score, n in table:
        left -= n
        if left <= 0:
            return drawn, score
    return drawn, 0
