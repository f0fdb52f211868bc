"""A Bloom filter of a column, of a bounded size, and rows that may be in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import _BLOCK_BYTES, _has, _hashes, _positions, _set, filter_bits


def build(values: DataFrame, bits_per_row: int = 16, max_filter_mb: int = 64) -> tuple[np.ndarray, int]:
    """(bits, log2 of their number) of a DataFrame of one text column; more rows than fit make it fuller, never wrong."""
    log2_bits = filter_bits(values.count(), bits_per_row, max_filter_mb)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << log2_bits) // 8, np.uint8)
        for batch in batches:
            _set(bits, _positions(_hashes(batch.column(0).to_pylist()), log2_bits))
        blocks = bits.reshape(-1, _BLOCK_BYTES)
        for block in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int32()), pa.array([blocks[block].tobytes()])], names=["block", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; one block is in memory at a time."""
        block, bits = None, None
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint8)
                if b == block:
                    bits |= own
                    continue
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()])], names=["block", "bits"])
                block, bits = b, own.copy()
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()])], names=["block", "bits"])

    parts = values.mapInArrow(partial, "block int, bits binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros((1 << log2_bits) // 8, np.uint8)
    for row in parts.mapInArrow(merged, "block int, bits binary").collect():  # the filter's size, however many rows
        out[row.block * _BLOCK_BYTES : (row.block + 1) * _BLOCK_BYTES] = np.frombuffer(row.bits, np.uint8)
    return out, log2_bits


def may_hold(values: DataFrame, column: str) -> Column:
    """Whether a row's column may be among values (a DataFrame of one text column); never false for one that is."""
    bits, log2_bits = build(values)
    shared = values.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(_has(shared.value, _positions(_hashes(keys), log2_bits)))

    return test(column)
