"""Line dedup with two Bloom filters.

Pass 1 hashes every line key inside its own task into two bit arrays, one for
keys seen once and one for keys seen twice; tasks' arrays are merged block by
block (a bit set by two tasks enters the twice array). Pass 2 keeps the lines
whose key may have been seen twice. Only those suspected lines shuffle: an exact
count by the key itself confirms them and picks the surviving document. Filters
have no false negatives, so a fuller filter costs time and never changes a result.

Texts are handled as UTF-8 bytes, whose lower() changes A-Z alone.

Defined cases: a null or empty text is one empty line; rows that share a doc_id
count as one document, rows without one as a document each, and rows that share
the surviving doc_id all keep their lines; a null doc_id is lower than any other, and if all holders have a null
doc_id nothing is dropped; rows without a doc_id find their dropped lines by their text's MD5, so they are no
group of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, portions, text_of

STRIP = " \t\n\x0b\x0c\r"
_STRIP = STRIP.encode()
_LOWER = {c: c + 32 for c in range(65, 91)}
_BLOCK_BYTES = 1 << 15
_PROBES = 4


def line_key(line: str) -> str:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(STRIP).translate(_LOWER) if not line.islower() else line.strip(STRIP)


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    keys = set()
    for line in (text or b"").lower().split(b"\n"):
        if len(line) >= min_chars:
            key = line.strip(_STRIP)
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                keys.add(key)
    return keys


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _positions(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """_PROBES bit positions of each hash, by double hashing; shape (n, probes)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(_PROBES, dtype=np.uint64)
    return (hashes[:, None] + probes * step[:, None] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - log2_bits)


def _set(bits: np.ndarray, pos: np.ndarray) -> None:
    np.bitwise_or.at(bits, (pos >> np.uint64(3)).ravel(), (np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8)).ravel())


def _has(bits: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((bits[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def filter_bits(n_lines: int, bits_per_line: int, max_filter_mb: int) -> int:
    """log2 of the filter's bits: bits_per_line for each line, within max_filter_mb."""
    wanted = max(_BLOCK_BYTES * 8, n_lines * bits_per_line)
    return min(math.ceil(math.log2(wanted)), int(math.log2(max_filter_mb * 8 * (1 << 20))))


def twice_seen(docs: DataFrame, min_chars: int, log2_bits: int) -> np.ndarray:
    """The merged twice-seen filter, 2**log2_bits bits."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros((1 << log2_bits) // 8, np.uint8)
        twice = np.zeros_like(once)
        for batch in batches:
            for part in portions(batch, 0, 512):
                pending: list[bytes] = []
                for text in _texts(part, 0):
                    pending.extend(_keys(text, min_chars))
                hashes, times = np.unique(_hashes(pending), return_counts=True)
                pos = _positions(hashes, log2_bits)
                _set(twice, pos[(times > 1) | _has(once, pos)])
                _set(once, pos)
        once, twice = once.reshape(-1, _BLOCK_BYTES), twice.reshape(-1, _BLOCK_BYTES)
        for block in np.flatnonzero(once.any(axis=1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block)], pa.int32()), pa.array([once[block].tobytes()]), pa.array([twice[block].tobytes()])],
                names=["block", "once", "twice"],
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; one block's two arrays are in memory at a time."""
        block, once, twice = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([twice.tobytes()])], names=["block", "twice"])

        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column(0)[i].as_py()
                o = np.frombuffer(batch.column(1)[i].as_py(), np.uint8)
                t = np.frombuffer(batch.column(2)[i].as_py(), np.uint8)
                if b != block:
                    if block is not None:
                        yield row()
                    block, once, twice = b, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        if block is not None:
            yield row()

    parts = docs.select("text").mapInArrow(partial, "block int, once binary, twice binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, twice binary")
    bits = np.zeros((1 << log2_bits) // 8, np.uint8)
    for row in blocks.collect():  # 2**log2_bits bits at most, however many rows there are
        bits[row.block * _BLOCK_BYTES : (row.block + 1) * _BLOCK_BYTES] = np.frombuffer(row.twice, np.uint8)
    return bits


def line_dedup(
    docs: DataFrame,
    min_docs: int = 3,
    min_chars: int = 20,
    bits_per_line: int = 16,
    max_filter_mb: int = 64,
) -> DataFrame:
    """docs with text rid of repeated lines, and n_lines, n_dropped (replacing columns so named).

    A key of at least min_chars code points held by at least min_docs documents
    loses all its lines except in the largest doc_id that holds it.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least: the filters find keys that were seen twice")
    spark = docs.sparkSession
    text = text_of()
    n_lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    log2_bits = filter_bits(n_lines, bits_per_line, max_filter_mb)
    shared = spark.sparkContext.broadcast(twice_seen(docs, min_chars, log2_bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in portions(batch, 2, 512):
                rows, keys = [], []
                for i, doc in enumerate(_texts(part, 2)):
                    own = _keys(doc, min_chars)
                    keys.extend(own)
                    rows.extend([i] * len(own))
                hit = np.flatnonzero(_has(bits, _positions(_hashes(keys), log2_bits))) if keys else []
                of = pa.array([rows[i] for i in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array([keys[i] for i in hit], pa.string())], names=["doc_id", "digest", "key"])

    digest = F.when(F.col("doc_id").isNull(), F.md5("text"))
    ids = docs.select(F.col("doc_id").cast("long"), digest.alias("digest"), "text")
    lines = materialise(ids.mapInArrow(suspected, "doc_id long, digest string, key string"), "line-dedup")
    # holders are counted by doc_id; a row without one is a document of its own
    by_key = lines.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows")).groupBy("key")
    holders = F.count("doc_id") + F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0))
    repeated = materialise(by_key.agg(holders.alias("holders"), F.max("doc_id").alias("keeper")).where(F.col("holders") >= min_docs).drop("holders"), "line-dedup-repeated")
    drops = lines.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy(F.col("doc_id").alias("__lf_id"), F.col("digest").alias("__lf_digest")).agg(F.collect_set("key").alias("__lf_keys"))

    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    @F.pandas_udf(result)
    def rebuild(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for doc, gone in zip(texts, keys, strict=True):
            doc = doc or ""
            if gone is None or len(gone) == 0:
                out.append((doc, doc.count("\n") + 1, 0))
                continue
            gone = {k.encode("utf-8", "surrogatepass") for k in gone}
            parts, lowered = doc.split("\n"), doc.encode("utf-8", "surrogatepass").lower().split(b"\n")
            kept = [x for x, k in zip(parts, lowered, strict=True) if k.strip(_STRIP) not in gone]
            out.append(("\n".join(kept), len(parts), len(parts) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    same_row = F.col("doc_id").cast("long").eqNullSafe(F.col("__lf_id")) & digest.eqNullSafe(F.col("__lf_digest"))
    joined = docs.join(drops.hint("shuffle_hash"), same_row, "left")
    done = joined.withColumn("__lf", rebuild("text", "__lf_keys"))
    same = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    columns = [F.col("__lf.text").alias("text") if c == "text" else F.col(c) for c in same]
    return done.select(*columns, "__lf.n_lines", "__lf.n_dropped")
