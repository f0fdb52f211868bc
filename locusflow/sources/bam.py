"""BAM as a Spark data source: ranges of blocks are read in parallel, an index prunes them; and a sink of indexed shards.

A file is cut into byte ranges. A task finds the first block in its range, and
in its bytes the first record: a place from which several records in a row have
sizes, names and references that fit. It gives the records that begin in its
range's blocks, so ranges meet without gap or overlap wherever they are cut. With a region and a .bai file beside,
only the ranges that the index names are read, from exact offsets.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.cigar import OPS
from .bgzf import BLOCK, BlockStream, find_block, pack_block
from .files import Shard, ShardFiles, abort_shards, commit_shards, exists, list_files, make_folder, open_file
from .shards import parse_spec, shard_name
from .vcf import BIN_LEVELS, BinIndex

READS_TYPE = "contig string, ref_start long, ref_end long, cigar array<struct<op:string,len:int>>, seq string, bq array<int>, mapq int, flag int, is_rev boolean, tlen int, name string, mate int, hp int, read_ordinal long"
_CIGAR = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
_KINDS = [pa.string(), pa.int64(), pa.int64(), _CIGAR, pa.string(), pa.list_(pa.int32()), *[pa.int32()] * 2, pa.bool_(), pa.int32(), pa.string(), *[pa.int32()] * 2, pa.int64()]
_SCHEMA = pa.schema(list(zip((c.strip().split(" ")[0] for c in READS_TYPE.replace("op:string,len:int", "").split(",")), _KINDS, strict=True)))
_BASES = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _BASES for b in _BASES]
_CODES = {b: i for i, b in enumerate(_BASES)}
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_FIXED = struct.Struct("<iiBBHHHiiii")
_SPANS = frozenset("M=XDN")
#: Records in a row that must fit before a place is taken for a record's start.
_CHAIN = 8
_LARGEST = 1 << 29


def tag_int(data: bytes, wanted: str) -> int | None:
    """An integer tag of a record's tags, None without one."""
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in _TAG_SIZES:
            if name == wanted and kind in _TAG_CODES:
                return struct.unpack_from(_TAG_CODES[kind], data, at)[0]
            at += _TAG_SIZES[kind]
        elif kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            at += 5 + n * _TAG_SIZES[sub]
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return None


def read_header(stream: BlockStream) -> tuple[list[tuple[str, int]], int]:
    """(name, length) of the contigs, and the place after the header."""

    def take(place: int, n: int) -> bytes:
        if not stream.need(place, n):
            raise ValueError("cut BAM header")
        return stream.bytes_at(place, n)

    if take(0, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack("<i", take(4, 4))[0]
    (n,) = struct.unpack("<i", take(at, 4))
    at, contigs = at + 4, []
    for _ in range(n):
        (size,) = struct.unpack("<i", take(at, 4))
        contigs.append((take(at + 4, size - 1).decode(), struct.unpack("<i", take(at + 4 + size, 4))[0]))
        at += 8 + size
    return contigs, at


def decode_record(data: bytes, contigs: list[tuple[str, int]], ordinal: int) -> tuple:
    """A row of READS_TYPE of a record without its size."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, _, _, tlen = _FIXED.unpack_from(data)
    at = 32 + l_name
    name = data[32 : at - 1].decode("latin-1")
    cigar = [(OPS[v & 15], v >> 4) for v in struct.unpack_from(f"<{n_cigar}I", data, at)]
    at += 4 * n_cigar
    seq = "".join(map(_PAIRS.__getitem__, data[at : at + (l_seq + 1) // 2]))[:l_seq]
    at += (l_seq + 1) // 2
    hp = tag_int(data[at + l_seq :], "HP")
    end = pos + sum(k for op, k in cigar if op in _SPANS)
    return (
        contigs[ref][0] if ref >= 0 else None, pos, end, [{"op": op, "len": k} for op, k in cigar], seq, list(data[at : at + l_seq]), mapq, flag,
        bool(flag & 16), tlen, name, 1 if flag & 64 else 2, hp if hp in (1, 2) else 0, ordinal,
    )


def fits(head: bytes, contigs: int) -> int | None:
    """The size of the record whose first 36 bytes (with its size) these may be; None if they can't."""
    (size,) = struct.unpack_from("<i", head)
    ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = _FIXED.unpack_from(head, 4)
    if not (-1 <= ref < contigs and -1 <= next_ref < contigs and pos >= -1 and next_pos >= -1 and l_name and l_seq >= 0):
        return None
    return size if 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size <= _LARGEST else None


def find_record(stream: BlockStream, hi: int, contigs: int) -> int | None:
    """The place of the first record that begins in a block before hi."""

    def chain(at: int) -> bool:
        for _ in range(_CHAIN):
            if not stream.need(at, 36):
                return not stream.need(at, 1)
            head = stream.bytes_at(at, 36)
            size = fits(head, contigs)
            if size is None or not stream.need(at, 4 + size):
                return False
            name = stream.bytes_at(at + 36, head[12])
            if name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1]):
                return False
            at += 4 + size
        return True

    at, known = 0, 0
    while stream.need(at, 36):
        if at >= known:  # another block
            if stream.virtual(at) >> 16 >= hi:
                return None
            known = stream.base + len(stream.data) if len(stream.blocks) == 1 else next((p for p in stream.places if p > at), stream.base + len(stream.data))
        if fits(stream.bytes_at(at, 36), contigs) is not None and chain(at):
            return at
        at += 1
    return None


@dataclass
class Range(InputPartition):
    """Records that begin in blocks of [lo, hi), from a virtual offset on and before another, where the index knows them."""

    uri: str
    lo: int
    hi: int
    first: int | None = None
    stop: int | None = None


def parse_index(data: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """By contig: chunks of virtual offsets by bin, and the offsets of the 16 kb windows."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    (n,), at, found = struct.unpack_from("<i", data, 4), 8, []
    for _ in range(n):
        (bins,), at, chunks = struct.unpack_from("<i", data, at), at + 4, {}
        for _ in range(bins):
            number, k = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
            chunks[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * k
        (windows,) = struct.unpack_from("<i", data, at)
        found.append((chunks, list(struct.unpack_from(f"<{windows}Q", data, at + 4))))
        at += 4 + 8 * windows
    return found


def region_chunks(index: tuple[dict[int, list[tuple[int, int]]], list[int]], start: int, end: int) -> list[tuple[int, int]]:
    """Merged chunks that may hold records over [start, end)."""
    bins, windows = index
    least = windows[min(start >> 14, len(windows) - 1)] if windows else 0
    wanted = [0, *(first + k for shift, first in BIN_LEVELS for k in range(start >> shift, (end - 1 >> shift) + 1))]
    merged: list[tuple[int, int]] = []
    for begin, after in sorted(c for b in wanted for c in bins.get(b, ()) if c[1] > least):
        if merged and begin >> 16 <= merged[-1][1] >> 16:
            merged[-1] = merged[-1][0], max(merged[-1][1], after)
        else:
            merged.append((begin, after))
    return merged


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("split_bytes", 32 << 20))
        self.contig = options.get("contig")
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 29))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri, size in list_files(self.paths, (".bam",)):
            cut = lambda lo, hi, uri=uri: [Range(uri, at, min(at + self.split, hi)) for at in range(lo, hi, self.split)]
            if self.contig is None or not exists(f"{uri}.bai"):
                out += cut(0, size)
                continue
            with open_file(uri) as file, open_file(f"{uri}.bai") as index:
                names = [name for name, _ in read_header(BlockStream(file, 0))[0]]
                known = parse_index(index.read())
            for begin, after in region_chunks(known[names.index(self.contig)], self.start, self.end) if self.contig in names else ():
                parts = cut(begin >> 16, (after >> 16) + 1)
                parts[0].first, parts[-1].stop = begin, after
                out += parts
        return out or [Range("", 0, 0)]  # nothing to read is one empty range

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.hi == 0:
            return
        with open_file(part.uri) as file:
            stream = BlockStream(file, 0)
            contigs, at = read_header(stream)
            body = stream.virtual(at) if stream.need(at, 1) else None
            if body is None or body >> 16 >= part.hi:
                return
            if part.first is not None:
                stream, at = BlockStream(file, part.first >> 16), part.first & 0xFFFF
            elif part.lo > body >> 16:
                block = find_block(file, part.lo, part.hi)
                if block is None:
                    return
                stream = BlockStream(file, block)
                at = find_record(stream, part.hi, len(contigs))
                if at is None:
                    return
            yield from self._batches(stream, at, part, contigs)

    def _batches(self, stream: BlockStream, at: int, part: Range, contigs: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        while stream.need(at, 4):
            here = stream.virtual(at)
            if here >> 16 >= part.hi or part.stop is not None and here >= part.stop:
                break
            (size,) = struct.unpack("<i", stream.bytes_at(at, 4))
            if size < 32 or not stream.need(at, 4 + size):
                raise ValueError(f"cut record at {here} of {part.uri}")
            row = decode_record(stream.bytes_at(at + 4, size), contigs, here)
            at += 4 + size
            stream.forget(at)
            if self.contig is None or row[0] == self.contig and row[1] < self.end and row[2] > self.start:
                rows.append(row)
                held += size
            if len(rows) == 4096 or held > 8 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def encode_record(row: dict, numbers: dict[str, int]) -> bytes:
    """A record with its size; a haplotype of 1 or 2 becomes a tag, the strand and the mate bits of the flag."""
    seq, name = row["seq"], row["name"].encode("latin-1") + b"\0"
    codes = [_CODES[b] for b in seq.upper()] + [0] * (len(seq) % 2)
    ops = [c["len"] << 4 | OPS.index(c["op"]) for c in row["cigar"]]
    flag = row["flag"] & ~(16 | 64 | 128) | (16 if row["is_rev"] else 0) | (64 if row["mate"] == 1 else 128)
    ref, pos, end = numbers.get(row["contig"], -1), row["ref_start"], max(row["ref_end"], row["ref_start"] + 1)
    body = _FIXED.pack(ref, pos, len(name), row["mapq"], BinIndex.bin_of(pos, end), len(ops), flag, len(seq), -1, -1, row["tlen"]) + name + struct.pack(f"<{len(ops)}I", *ops)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(row["bq"])
    body += b"HPC" + bytes([row["hp"]]) if row["hp"] in (1, 2) else b""
    return struct.pack("<i", len(body)) + body


def header_bytes(contigs: list[tuple[str, int]]) -> bytes:
    text = b"@HD\tVN:1.6\tSO:coordinate\n" + b"".join(f"@SQ\tSN:{name}\tLN:{n}\n".encode() for name, n in contigs)
    names = b"".join(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n) for name, n in contigs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + names


class BamWriter(DataSourceArrowWriter):
    """Each partition, which comes in file order, as a shard of its own with its index; names are given when all are written."""

    def __init__(self, options: dict[str, str]):
        self.folder, _, self.spec = options["path"].rpartition("/")
        self.contigs = [(name, n) for name, n in json.loads(options["contigs"])]
        self.block = int(options.get("block_bytes", BLOCK))
        make_folder(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        return self._write(ShardFiles(self.folder), iterator)

    def _write(self, files: ShardFiles, batches: Iterable[pa.RecordBatch]) -> Shard:
        name = shard_name(self.spec, files.number)
        index, numbers = BinIndex(), {name: i for i, (name, _) in enumerate(self.contigs)}
        with files.create(name) as out:
            at = 0

            def put(data: bytes) -> None:
                nonlocal at
                packed = pack_block(data)
                out.write(packed)
                at += len(packed)

            head = header_bytes(self.contigs)
            for lo in range(0, len(head), BLOCK):
                put(head[lo : lo + BLOCK])
            held = bytearray()
            for batch in batches:
                for row in batch.to_pylist():
                    data = encode_record(row, numbers)
                    if held and len(held) + len(data) > self.block:
                        put(bytes(held))
                        held.clear()
                    begin = at << 16 | len(held)
                    held += data
                    while len(held) > self.block:
                        put(bytes(held[: self.block]))
                        del held[: self.block]
                    if row["contig"] in numbers:
                        index.add(row["contig"], row["ref_start"], row["ref_end"], begin, at << 16 | len(held))
            if held:
                put(bytes(held))
            out.write(pack_block(b""))
        with files.create(f"{name}.bai") as out:
            out.write(index.bai([name for name, _ in self.contigs]))
        return files.done()

    def commit(self, messages: list[Shard | None]) -> None:
        commit_shards(self.folder, messages, parse_spec(self.spec)[1], lambda files: self._write(files, ()))

    def abort(self, messages: list[Shard | None]) -> None:
        abort_shards(self.folder, messages)


class BamSource(DataSource):
    """format("locus_bam"). Reading: path or paths (JSON list), split_bytes, and contig, start, end of a region. Writing: path base@N.bam, contigs (JSON list of names and lengths)."""

    @classmethod
    def name(cls) -> str:
        return "locus_bam"

    def schema(self) -> str:
        return READS_TYPE

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        parse_spec(self.options["path"])
        return BamWriter(dict(self.options))

