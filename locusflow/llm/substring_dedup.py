"""Substring dedup over sliding runs of sentences.

Texts are split into sentences (after ``.!?`` before white space, and at line
feeds). Every run of so many consecutive sentences with enough words is hashed
(128 bits), from every sentence on; there are runs of two lengths. All hashes are
grouped once, with partial aggregation, to find the first occurrence of each
repeated run, by doc_id and place; a sentence goes if a run that isn't the first
covers it. Repeated runs are a table of their own before the runs are joined with
it, so that Spark may split a run that very many documents have.

Defined cases: a null text is the empty text and has no sentence; white space is
blank, tab, line feed, carriage return, form feed and vertical tab; the first
occurrence is in the least doc_id, null being the greatest; rows are documents of
their own, also those that repeat a doc_id or have none: of one doc_id they go by
a hash of the text, and of equal texts one comes first; a text is stripped at its
ends only if something was removed. Repeats of fewer sentences or words than a
run has stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, portions, text_of

SPACE = b" \t\n\r\x0b\x0c"
#: What ends a sentence, the white space after it included.
BREAK = r"[.!?][ \t\r\f\v]+|[ \t\r\f\v]*\n[ \t\n\r\f\v]*"
#: Lengths of runs: (sentences, words at least).
RUNS = ((3, 12), (2, 16))
_BREAK = re.compile(BREAK.encode())
_LAST = (1 << 63) - 1


def sentences(text: bytes) -> tuple[list[bytes], list[int]]:
    """The text in units, a sentence and the white space after it each, and the places of units with words."""
    ends = [m.end() for m in _BREAK.finditer(text)]
    units = [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)], strict=True) if i < j]
    return units, [i for i, u in enumerate(units) if u.strip(SPACE)]


def runs(words: list[int], kinds: tuple[tuple[int, int], ...] = RUNS) -> list[tuple[int, int]]:
    """Runs (first, last) over sentences of so many words."""
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    return [(i, i + k - 1) for k, least in kinds for i in range(len(words) - k + 1) if total[i + k] - total[i] >= least]


def _row_key() -> tuple[Column, Column]:
    """What tells rows apart, but for those of one doc_id and text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text", F.col("doc_id").isNull())


def _hashed_runs(docs: DataFrame, kinds: tuple[tuple[int, int], ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2, rows=512):
                ids, hashes, digests, starts, ends = [], [], [], [], []
                for doc_id, text_hash, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    units, places = sentences(text)
                    kept = [units[i].strip(SPACE) for i in places]
                    own = b"".join(map(xxhash.xxh3_128_digest, kept))
                    found = runs([len(s.split()) for s in kept], kinds)
                    ids.extend([doc_id] * len(found))
                    hashes.extend([text_hash] * len(found))
                    digests.extend([xxhash.xxh3_128_digest(own[16 * i : 16 * j + 16]) for i, j in found])
                    starts.extend([i for i, _ in found])
                    ends.extend([j for _, j in found])
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["hi", "lo", "doc_id", "text_hash", "first", "last"])

    own = docs.select(*_row_key(), text_of().cast("binary"))
    return own.mapInArrow(run, "hi long, lo long, doc_id long, text_hash long, first int, last int")


def repeated_runs(docs: DataFrame, kinds: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """Runs that occurred before: doc_id, text_hash, first and last (sentences with words, from 0), first_doc_id.

    A null doc_id is shown as the greatest long. Rows of one doc_id and text are
    taken for one here.
    """
    every = _hashed_runs(docs, kinds)
    place = F.struct("doc_id", "text_hash", "first")
    origin = every.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("origin")).where("times > 1").drop("times")
    again = every.join(materialise(origin, "substring-origins"), ["hi", "lo"]).where(place > F.col("origin"))
    return again.select("doc_id", "text_hash", "first", "last", F.col("origin.doc_id").alias("first_doc_id"))


def substring_dedup(docs: DataFrame, kinds: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """docs with text rid of repeated sentences, and n_sentences, n_removed, first_doc_ids (replacing columns so named).

    first_doc_ids: where what was removed occurs first. kinds: lengths of runs,
    (sentences, words at least).
    """
    again = repeated_runs(docs, kinds)
    # the join by run ends in a shuffle of its own, so that a run of very many rows can be split
    spans = again.groupBy(F.col("doc_id").alias("__lf_id"), F.col("text_hash").alias("__lf_hash")).agg(F.collect_set(F.struct("first", "last")).alias("__lf_spans"), F.sort_array(F.collect_set("first_doc_id")).alias("__lf_from"))
    spans = spans.select("__lf_id", "__lf_hash", "__lf_from", F.transform("__lf_spans", lambda s: s["first"]).alias("__lf_first"), F.transform("__lf_spans", lambda s: s["last"]).alias("__lf_last"))
    result = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("own", T.BooleanType())])

    @F.pandas_udf(result)
    def rebuild(texts: pd.Series, copies: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        out = []
        for text, copy, first, last in zip(texts, copies, firsts, lasts, strict=True):
            units, places = sentences(text)
            own = False
            if copy > 1:
                # all runs of a copy occurred before: in the first one of its kind, if not elsewhere
                before = set() if first is None else set(zip(first, last, strict=True))
                every = runs([len(units[i].split()) for i in places], kinds)
                own = not before.issuperset(every)
                first, last = [i for i, _ in every], [j for _, j in every]
            if first is None or len(first) == 0:
                out.append((text, len(places), 0, own))
                continue
            edges = np.zeros(len(places) + 1, np.int64)
            np.add.at(edges, np.asarray(first), 1)
            np.add.at(edges, np.asarray(last) + 1, -1)
            gone = {places[i] for i in np.flatnonzero(np.cumsum(edges)[:-1])}
            kept = b"".join(u for i, u in enumerate(units) if i not in gone)
            out.append((kept.strip(SPACE), len(places), len(gone), own))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "own"])

    doc_id, text_hash = _row_key()
    alike = Window.partitionBy("__lf_id", "__lf_hash").orderBy("__lf_id")
    keyed = docs.withColumn("__lf_id", doc_id).withColumn("__lf_hash", text_hash).withColumn("__lf_copy", F.row_number().over(alike))
    done = keyed.join(spans.hint("shuffle_hash"), ["__lf_id", "__lf_hash"], "left").withColumn("__lf", rebuild(text_of().cast("binary"), "__lf_copy", "__lf_first", "__lf_last"))
    found = F.coalesce("__lf_from", F.array().cast("array<bigint>"))
    found = F.when(F.col("__lf.own"), F.sort_array(F.array_union(found, F.array("__lf_id")))).otherwise(found)
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "first_doc_ids")]
    columns = [F.col("__lf.text").cast("string").alias("text") if c == "text" else F.col(c) for c in kept]
    return done.select(*columns, "__lf.n_sentences", "__lf.n_removed", found.alias("first_doc_ids"))
