"""VCF and gVCF sinks."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vcf_text import VARIANT_KEYS, gvcf_text, header_text, record_text
from ..operators.genotyping import in_file_order
from .bgzf import pack_blocks


def write_parts(records: DataFrame, path: str, contigs: list[tuple[int, str, int]], gvcf: bool = False, keys: tuple[str, ...] = VARIANT_KEYS) -> None:
    """A folder of sorted text parts without headers, made by all executors."""
    ordered = in_file_order(records, [name for _, name, _ in contigs])
    columns = set(records.columns)
    ordered.select((gvcf_text(columns) if gvcf else record_text(keys, columns)).alias("value")).write.text(path)


def write_file(records: DataFrame, path: str, contigs: list[tuple[int, str, int]], samples: list[str], gvcf: bool = False, keys: tuple[str, ...] = VARIANT_KEYS, caller_line: str = "") -> None:
    """One file on the driver's machine, rows being fetched part by part; BGZF with an index beside it if it ends in .gz."""
    ordered = in_file_order(records, [name for _, name, _ in contigs])
    columns = set(records.columns)
    lines = ordered.select("contig", "start", "end", (gvcf_text(columns) if gvcf else record_text(keys, columns)).alias("line"))
    head = header_text(contigs, samples, caller_line).encode()
    if not path.endswith(".gz"):
        with open(path, "wb") as out:
            out.write(head)
            for row in lines.toLocalIterator():
                out.write(row.line.encode() + b"\n")
        return
    index = BinIndex()
    with open(path, "wb") as out:
        out.write(pack_blocks(head)[:-28])
        block: list[bytes] = []
        size, rows = 0, []

        def flush() -> None:
            nonlocal size
            if not block:
                return
            begin = out.tell()
            out.write(pack_blocks(b"".join(block))[:-28])
            for contig, start, end, at, after in rows:
                last = after == size
                index.add(contig, start, end, begin << 16 | at, out.tell() << 16 if last else begin << 16 | after)
            block.clear()
            rows.clear()
            size = 0

        for row in lines.toLocalIterator():
            text = row.line.encode() + b"\n"
            if size + len(text) > 0xFF00:
                flush()
            rows.append((row.contig, row.start, row.end, size, size + len(text)))
            block.append(text)
            size += len(text)
        flush()
        out.write(pack_blocks(b"")[-28:])
    with open(f"{path}.tbi", "wb") as out:
        out.write(pack_blocks(index.tobytes()))


#: Nested bins: shift of their width and number of the first, from the narrowest.
BIN_LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))


class BinIndex:
    """Bins and 16 kb windows of sorted records, by virtual offsets; as a tabix or a BAM index."""

    def __init__(self) -> None:
        self.bins: dict[str, dict[int, list[list[int]]]] = {}
        self.windows: dict[str, dict[int, int]] = {}

    @staticmethod
    def bin_of(start: int, end: int) -> int:
        """The smallest of the nested bins that holds [start, end)."""
        last = max(end, start + 1) - 1
        for shift, first in BIN_LEVELS:
            if start >> shift == last >> shift:
                return first + (start >> shift)
        return 0

    def add(self, contig: str, start: int, end: int, begin: int, after: int) -> None:
        chunks = self.bins.setdefault(contig, {}).setdefault(self.bin_of(start, end), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = after
        else:
            chunks.append([begin, after])
        windows = self.windows.setdefault(contig, {})
        for w in range(start >> 14, (max(end, start + 1) - 1 >> 14) + 1):
            windows.setdefault(w, begin)

    def tobytes(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.bins)
        out = [b"TBI\1", struct.pack("<8i", len(self.bins), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
        return b"".join([*out, *map(self._contig, self.bins)])

    def bai(self, contigs: list[str]) -> bytes:
        """A BAM index, contigs in the order of the header."""
        return b"".join([b"BAI\1", struct.pack("<i", len(contigs)), *map(self._contig, contigs)])

    def _contig(self, contig: str) -> bytes:
        bins = self.bins.get(contig, {})
        out = [struct.pack("<i", len(bins))]
        for number, chunks in sorted(bins.items()):
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        windows, offsets, held = self.windows.get(contig, {}), [], 0
        for w in range(max(windows, default=-1) + 1):
            held = windows.get(w, held)
            offsets.append(held)
        out.append(struct.pack("<i", len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets))
        return b"".join(out)


def read_records(df: DataFrame) -> DataFrame:
    """Columns of VCF lines (value): contig, start, ref, alts, qual, filter, info, keys, call."""
    parts = F.split("value", "\t")
    at = lambda i: F.get(parts, F.lit(i))
    return df.where(~F.startswith("value", F.lit("#"))).select(at(0).alias("contig"), (at(1).cast("long") - 1).alias("start"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), at(5).try_cast("double").alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("keys"), at(9).alias("call"))
