"""Record files as a Spark data source and sink: frames found from any offset, shards named on commit; rows as example messages.

A plain file is cut into byte ranges. A task looks for a frame's start in its
range: 12 bytes whose second part is the masked CRC-32C of the first, and behind
which the payload and its sum fit. It gives the frames that begin in its range. Gzipped files
can't be cut: each is one task, and streamed.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import NativeFile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import Shard, ShardFiles, abort_shards, commit_shards, list_files, make_folder, open_file
from .shards import parse_spec, shard_name
from .tfrecord import CRC_TABLES, MASK_DELTA, decode_features, encode_features, frame, masked_crc, output_message, read_records

SCHEMA = "path string, ordinal long, payload binary"
_SCHEMA = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("payload", pa.binary())])
_WINDOW = 1 << 20
_BATCH_BYTES = 8 << 20


def frame_starts(data: bytes) -> np.ndarray:
    """Places in data where a length and its masked sum stand, all checked at once."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - 11
    if n <= 0:
        return np.zeros(0, np.int64)
    crc = np.zeros(n, np.uint32)
    for k in range(8):
        table = np.array(CRC_TABLES[7 - k], np.uint32)
        crc ^= table[raw[k : k + n] ^ (0xFF if k < 4 else 0)]
    crc ^= np.uint32(0xFFFFFFFF)
    masked = (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)
    stated = sum(raw[8 + k : 8 + k + n].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    return np.flatnonzero(masked == stated)


def _payload(file: NativeFile, at: int) -> bytes:
    """The payload of the frame at an offset; an error for a cut frame or a wrong sum."""
    file.seek(at)
    head = file.read(12)
    if len(head) < 12:
        raise ValueError("cut record: length")
    size, check = struct.unpack("<QI", head)
    if masked_crc(head[:8]) != check:
        raise ValueError("wrong CRC of a record's length")
    body = file.read(size + 4)
    if len(body) < size + 4:
        raise ValueError("cut record: payload")
    if masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("wrong CRC of a record's payload")
    return body[:size]


def first_frame(file: NativeFile, lo: int, hi: int, size: int) -> int | None:
    """The first frame that begins in [lo, hi) of a file of a size, and is followed by another or by the end."""
    if lo == 0:
        return 0 if size else None
    for at in range(lo, hi, _WINDOW):
        file.seek(at)
        data = file.read(min(_WINDOW, hi - at) + 11)
        for place in frame_starts(data):
            begin = at + int(place)
            try:
                after = begin + 16 + len(_payload(file, begin))
            except ValueError:
                continue
            file.seek(after)
            if after == size or len(frame_starts(file.read(12))):
                return begin
    return None


@dataclass
class Span(InputPartition):
    """Frames that begin in [lo, hi) of a file; whole: it is gzipped."""

    uri: str
    lo: int
    hi: int
    size: int
    whole: bool


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri, size in list_files(self.paths, ("",)):
            if uri.rsplit("/", 1)[-1].startswith(("_", ".")):
                continue
            if uri.endswith(".gz"):
                out.append(Span(uri, 0, size, size, True))
            else:
                out += [Span(uri, at, min(at + self.split, size), size, False) for at in range(0, size, self.split)]
        return out or [Span("", 0, 0, 0, False)]  # nothing to read is one empty range

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        if part.hi == 0:
            return
        with open_file(part.uri) as file:
            frames = enumerate(read_records(gzip.GzipFile(fileobj=file))) if part.whole else self._frames(file, part)
            rows: list[tuple[int, bytes]] = []
            held = 0
            for ordinal, payload in frames:
                rows.append((ordinal, payload))
                held += len(payload)
                if held > _BATCH_BYTES or len(rows) == 4096:
                    yield self._batch(part.uri, rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(part.uri, rows)

    @staticmethod
    def _frames(file: NativeFile, part: Span) -> Iterator[tuple[int, bytes]]:
        """A plain file's ordinals are offsets, so that they need no count of the frames before."""
        at = first_frame(file, part.lo, part.hi, part.size)
        while at is not None and at < part.hi:
            payload = _payload(file, at)
            yield at, payload
            at += 16 + len(payload)

    @staticmethod
    def _batch(uri: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ordinals, payloads = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([uri] * len(rows)), pa.array(ordinals, pa.int64()), pa.array(payloads, pa.binary())], schema=_SCHEMA)


class RecordWriter(DataSourceArrowWriter):
    """Each partition's payloads as one shard, gzipped if its name says so; names are given when all shards are written."""

    def __init__(self, path: str):
        self.folder, _, self.spec = path.rpartition("/")
        make_folder(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        return self._write(ShardFiles(self.folder), iterator)

    def _write(self, files: ShardFiles, batches: Iterable[pa.RecordBatch]) -> Shard:
        name = shard_name(self.spec, files.number)
        with files.create(name) as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if name.endswith(".gz") else raw
            for batch in batches:
                for payload in batch.column("payload").to_pylist():
                    out.write(frame(payload or b""))
            if out is not raw:
                out.close()
        return files.done()

    def commit(self, messages: list[Shard | None]) -> None:
        commit_shards(self.folder, messages, parse_spec(self.spec)[1], lambda files: self._write(files, ()))

    def abort(self, messages: list[Shard | None]) -> None:
        abort_shards(self.folder, messages)


class RecordSource(DataSource):
    """format("locus_records"). Reading: path or paths (JSON list), split_bytes. Writing: path base@N or base@N.suffix."""

    @classmethod
    def name(cls) -> str:
        return "locus_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"])


def read_record_files(spark: SparkSession, paths: str | list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """path, ordinal, payload of all records of files and folders.

    ordinal grows along a file: a plain file's offsets, a gzipped one's counts.
    """
    spark.dataSource.register(RecordSource)
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.format("locus_records").option("paths", json.dumps(paths)).option("split_bytes", split_bytes).load()


def write_record_files(payloads: DataFrame, spec: str, *order: str) -> None:
    """payload of payloads as the N files of 'base@N' or 'base@N.suffix', written by N tasks; in ranges of the order if one is given."""
    spark, (_, shards, _) = payloads.sparkSession, parse_spec(spec)
    spark.dataSource.register(RecordSource)
    # a shard is written for every partition, empty ones too
    dealt = payloads.repartitionByRange(shards, *order).sortWithinPartitions(*order) if order else payloads.repartition(shards)
    dealt.select("payload").write.format("locus_records").mode("append").save(spec)


def encode_rows(df: DataFrame) -> DataFrame:
    """Each row as an example message (payload): a feature a column, ordered by name; null columns are left out.

    Strings, binaries, whole numbers, booleans and doubles (eight bytes each, so that nothing is rounded), and arrays of them.
    """
    schema = df.schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f.name).to_pylist() for f in schema]
            rows = [encode_features({f.name: _values(v, f.dataType) for f, v in zip(schema, row, strict=True) if v is not None}) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["payload"])

    return df.mapInArrow(encode, "payload binary")


def decode_rows(payloads: DataFrame, schema: str, sizes: dict[str, int] | None = None) -> DataFrame:
    """The columns of a schema from example messages (payload), null where a feature is missing.

    sizes: bytes that a binary column must have; another size is an error.
    """
    wanted = StructType.fromDDL(schema)
    sizes = sizes or {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(wanted)
        for batch in batches:
            rows = [decode_features(p) for p in batch.column("payload").to_pylist()]
            columns = [pa.array([_value(row.get(f.name), f.dataType) for row in rows], arrow.field(f.name).type) for f in wanted]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    found = payloads.select("payload").mapInArrow(decode, schema)
    for name, n in sizes.items():
        right = F.col(name).isNull() | (F.length(name) == n)
        found = found.withColumn(name, F.when(right, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} has not {n} bytes")).cast("binary")))
    return found


def decode_outputs(payloads: DataFrame) -> DataFrame:
    """variant (bytes), alt_idx, probs of model outputs' messages (payload)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [output_message(p) for p in batch.column("payload").to_pylist()]
            kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["variant", "alt_idx", "probs"])

    return payloads.select("payload").mapInArrow(decode, "variant binary, alt_idx array<int>, probs array<double>")


def _is_double(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _values(value: object, kind: T.DataType) -> list:
    if isinstance(kind, T.ArrayType):
        return [x for v in value for x in _values(v, kind.elementType)]
    if _is_double(kind):
        return [struct.pack("<d", value)]
    if isinstance(kind, T.StringType):
        return [value.encode()]
    return [bytes(value)] if isinstance(kind, T.BinaryType) else [int(value)]


def _value(values: list | None, kind: T.DataType) -> object:
    if values is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_value([v], kind.elementType) for v in values]
    if not values:
        return None
    if _is_double(kind):
        return struct.unpack("<d", values[0])[0]
    if isinstance(kind, T.StringType):
        return values[0].decode()
    return bool(values[0]) if isinstance(kind, T.BooleanType) else values[0]
