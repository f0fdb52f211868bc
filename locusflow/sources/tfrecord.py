"""Record files of length-prefixed payloads with masked CRC-32C sums, plain or gzipped."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

MASK_DELTA = 0xA282EAD8


def _crc_tables(n: int = 8) -> list[list[int]]:
    table = []
    for b in range(256):
        c = b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        table.append(c)
    tables = [table]
    for _ in range(n - 1):
        tables.append([table[c & 255] ^ c >> 8 for c in tables[-1]])
    return tables


CRC_TABLES = _crc_tables()


def crc32c(data: bytes) -> int:
    """The Castagnoli CRC, eight bytes a step."""
    c, t, whole = 0xFFFFFFFF, CRC_TABLES, len(data) // 8 * 8
    for lo, hi in struct.iter_unpack("<II", data[:whole]):
        lo ^= c
        c = t[7][lo & 255] ^ t[6][lo >> 8 & 255] ^ t[5][lo >> 16 & 255] ^ t[4][lo >> 24] ^ t[3][hi & 255] ^ t[2][hi >> 8 & 255] ^ t[1][hi >> 16 & 255] ^ t[0][hi >> 24]
    for b in data[whole:]:
        c = t[0][(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def read_records(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """Payloads until a clean end; an error for a cut frame or a wrong sum."""
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError("cut record: length")
        size, check = struct.unpack("<QI", head)
        if masked_crc(head[:8]) != check:
            raise ValueError("wrong CRC of a record's length")
        payload, tail = stream.read(size), stream.read(4)
        if len(payload) < size or len(tail) < 4:
            raise ValueError("cut record: payload")
        if masked_crc(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError("wrong CRC of a record's payload")
        yield payload


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def records_of(data: bytes, gzipped: bool) -> Iterator[bytes]:
    return read_records(gzip.GzipFile(fileobj=io.BytesIO(data)) if gzipped else io.BytesIO(data))


def read_tfrecords(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, ordinal, payload of all records; see records.read_record_files."""
    from .records import read_record_files

    return read_record_files(spark, paths)


def write_tfrecords(payloads: list[bytes], path: str) -> None:
    """One small file on the caller's machine, gzipped if it ends in .gz; records.write_record_files writes tables as shards."""
    with gzip.open(path, "wb") if path.endswith(".gz") else open(path, "wb") as out:
        for p in payloads:
            out.write(frame(p))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def encode_example(features: dict[str, bytes]) -> bytes:
    """An example message of byte features, ordered by key."""
    return encode_features({k: [v] for k, v in features.items()})


def encode_features(features: dict[str, list]) -> bytes:
    """An example message of lists of bytes or of whole numbers, ordered by key."""

    def body(values: list) -> bytes:
        if values and isinstance(values[0], int):
            return _field(3, _field(1, b"".join(_varint(v & (1 << 64) - 1) for v in values)))
        return _field(1, b"".join(_field(1, v) for v in values))

    return _field(1, b"".join(_field(1, _field(1, k.encode()) + _field(2, body(v))) for k, v in sorted(features.items())))


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        if key & 7 != 2:
            raise ValueError("only length-delimited fields are expected here")
        size = number()
        yield key >> 3, data[at : at + size]
        at += size


def decode_example(payload: bytes) -> dict[str, bytes]:
    """The byte features of an example message, one value each."""
    return {k: next(iter(v), b"") for k, v in decode_features(payload).items()}


def decode_features(payload: bytes) -> dict[str, list]:
    """The features of an example message: lists of bytes, or of whole numbers."""
    out: dict[str, list] = {}
    for _, features in _fields(payload):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            kind, values = next(_fields(parts.get(2, b"")), (1, b""))
            if kind not in (1, 3):
                raise ValueError("a feature is neither of bytes nor of whole numbers")
            out[parts[1].decode()] = [v for _, v in _fields(values)] if kind == 1 else [n for _, packed in _fields(values) for n in _numbers(packed)]
    return out


def _numbers(packed: bytes) -> Iterator[int]:
    """Signed 64-bit numbers of a packed list."""
    n = shift = 0
    for b in packed:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            yield n - (1 << 64) if n >> 63 else n
            n = shift = 0


def output_message(payload: bytes) -> tuple[bytes, list[int], list[float]]:
    """A model output's variant (as its bytes), alternate indices and probabilities."""
    variant, indices, probabilities = b"", [], []
    for number, value in _fields(payload):
        if number == 1:
            variant = value
        elif number == 2:
            indices = [n for _, packed in _fields(value) for n in _numbers(packed)]
        elif number == 3:
            probabilities += struct.unpack(f"<{len(value) // 8}d", value)
    return variant, indices, probabilities
