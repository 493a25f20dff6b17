"""Block gzip: blocks of at most 64 KiB, each a gzip member that tells its own size."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from ..errors import BgzfError
from .files import is_bgzf_header

#: Fixed value: the empty block that ends a stream.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
PAYLOAD = 60 * 1024
MAX_BLOCK = 64 * 1024
_HEAD = 18


def block_size(header: bytes) -> int:
    """Bytes of the block that a header of 18 bytes opens."""
    if not is_bgzf_header(header):
        raise BgzfError("invalid BGZF header")
    size = struct.unpack_from("<H", header, 16)[0] + 1
    if size < 26:
        raise BgzfError("invalid BGZF block size")
    return size


def inflate(block: bytes) -> bytes:
    """The payload of a whole block, checked."""
    extra = struct.unpack_from("<H", block, 10)[0]
    crc, size = struct.unpack_from("<II", block, len(block) - 8)
    if size > MAX_BLOCK:
        raise BgzfError("BGZF uncompressed block exceeds 64 KiB")
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(block[12 + extra : -8], size + 1)
    except zlib.error as e:
        raise BgzfError(str(e)) from e
    if len(out) > MAX_BLOCK:
        raise BgzfError("BGZF uncompressed block exceeds 64 KiB")
    if len(out) > size:
        raise BgzfError("BGZF uncompressed block exceeds advertised size")
    if len(out) != size:
        raise BgzfError("uncompressed size mismatch")
    if zlib.crc32(out) != crc:
        raise BgzfError("CRC32 mismatch")
    return out


def deflate(payload: bytes, level: int = 6) -> bytes:
    """One block of a payload of at most 64 KiB."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(payload) + z.flush()
    if len(body) + 26 > MAX_BLOCK:
        z = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = z.compress(payload) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def compress(data: bytes, level: int = 6) -> bytes:
    """A stream of blocks of 60 KiB and the end block."""
    return b"".join(deflate(data[i : i + PAYLOAD], level) for i in range(0, len(data), PAYLOAD)) + EOF_BLOCK


def hop(f, offset: int, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of the blocks from `offset` that start before `end`, without inflating."""
    while end is None or offset < end:
        f.seek(offset)
        header = f.read(_HEAD)
        if not header:
            return
        if len(header) < _HEAD:
            raise BgzfError("short block")
        size = block_size(header)
        f.seek(offset + size - 4)
        tail = f.read(4)
        if len(tail) < 4:
            raise BgzfError("short block")
        yield offset, size, struct.unpack("<I", tail)[0]
        offset += size


def first_block(f, start: int, size: int) -> int | None:
    """Where the first block at or after `start` begins: a header whose block is followed by another, or by the end."""
    if start == 0:
        return 0
    f.seek(start)
    window = f.read(2 * MAX_BLOCK + _HEAD)
    at = window.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        offset, ok = start + at, True
        for _ in range(2):
            f.seek(offset)
            header = f.read(_HEAD)
            if offset == size:
                break
            if not is_bgzf_header(header):
                ok = False
                break
            offset += struct.unpack_from("<H", header, 16)[0] + 1
            if offset > size:
                ok = False
                break
        if ok:
            return start + at
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


def read_blocks(f, offset: int, end: int | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, block, payload) of the blocks from `offset` that start before `end`; stops at the end of the file."""
    f.seek(offset)
    while end is None or offset < end:
        header = f.read(_HEAD)
        if not header:
            return
        if len(header) < _HEAD:
            raise BgzfError("short block")
        size = block_size(header)
        block = header + f.read(size - _HEAD)
        if len(block) < size:
            raise BgzfError("short block")
        yield offset, block, inflate(block)
        offset += size
