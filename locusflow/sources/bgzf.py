"""Blocked gzip: packing, and reading from any block on, with virtual offsets."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

from pyarrow import NativeFile

#: Bytes that a block holds at most when packed here.
BLOCK = 0xFF00
_READ = 1 << 18
_MAGIC = b"\x1f\x8b\x08\x04"


def pack_block(part: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(part) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(part), len(part))


def pack_blocks(data: bytes) -> bytes:
    """BGZF blocks of data, with the empty block that ends a file."""
    return b"".join(pack_block(data[at : at + BLOCK]) for at in range(0, len(data), BLOCK)) + pack_block(b"")


def unpack_blocks(data: bytes) -> bytes:
    """The bytes of a BGZF (multi-member gzip) file."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("cut BGZF block")
        data = member.unused_data
    return b"".join(out)


def block_size(data: bytes | bytearray, at: int) -> int | None:
    """The size of the block that starts at a place of data; None if none starts there or its head is cut."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    field, end = at + 12, at + 12 + extra
    while field + 6 <= min(end, len(data)):
        kind, size = bytes(data[field : field + 2]), struct.unpack_from("<H", data, field + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def unpack_block(block: bytes) -> bytes:
    """A whole block's bytes, its sums checked."""
    (extra,) = struct.unpack_from("<H", block, 10)
    part = zlib.decompress(block[12 + extra : -8], -15)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(part), len(part)):
        raise ValueError("wrong sum of a BGZF block")
    return part


def find_block(file: NativeFile, lo: int, hi: int) -> int | None:
    """The first block that starts in [lo, hi) of a file; the bytes that look like a head are read as a block to make sure."""
    if lo == 0:
        return 0
    file.seek(lo)
    data, end = bytearray(), False
    at = 0
    while True:
        if len(data) < at + (1 << 17) and not end:
            more = file.read(_READ)
            end = not more
            data += more
            if more:
                continue
        at = data.find(_MAGIC, at)
        if at < 0 or lo + at >= hi:
            return None
        size = block_size(data, at)
        if size and at + size <= len(data):
            try:
                unpack_block(bytes(data[at : at + size]))
                return lo + at
            except (ValueError, zlib.error):
                pass
        at += 1


class BlockStream:
    """The unpacked bytes of a BGZF file from a block on; a place is a count of bytes from there."""

    def __init__(self, file: NativeFile, block: int):
        self.file, self.next = file, block
        self.raw, self.raw_at = b"", block
        self.data, self.base = bytearray(), 0
        self.places, self.blocks = [], []

    def more(self) -> bool:
        """One block more; False at the file's end."""
        while True:
            at = self.next - self.raw_at
            size = block_size(self.raw, at)
            if size and at + size <= len(self.raw):
                break
            self.file.seek(self.next)
            fresh = self.file.read(_READ)
            if not fresh:
                return False
            if self.raw_at == self.next and len(fresh) <= len(self.raw) or block_size(fresh, 0) is None:
                raise ValueError("cut BGZF block")
            self.raw, self.raw_at = fresh, self.next
        part = unpack_block(self.raw[at : at + size])
        if part:
            self.places.append(self.base + len(self.data))
            self.blocks.append(self.next)
            self.data += part
        self.next += size
        return True

    def need(self, place: int, n: int) -> bool:
        """Whether n bytes from a place are there."""
        while self.base + len(self.data) < place + n:
            if not self.more():
                return False
        return True

    def bytes_at(self, place: int, n: int) -> bytes:
        return bytes(self.data[place - self.base : place - self.base + n])

    def virtual(self, place: int) -> int:
        """The virtual offset of a byte that was read: its block's place in the file, shifted, and its place in the block."""
        nth = bisect_right(self.places, place) - 1
        return self.blocks[nth] << 16 | place - self.places[nth]

    def forget(self, place: int) -> None:
        """Bytes before a place aren't needed any more."""
        nth = bisect_right(self.places, place) - 1
        if nth > 0:
            cut = self.places[nth]
            del self.data[: cut - self.base], self.places[:nth], self.blocks[:nth]
            self.base = cut
