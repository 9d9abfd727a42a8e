"""Block gzip: reading by block, and a writer of sorted tables."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An empty block marks the end of a file (fixed value).
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00


def compress_block(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


def compress(data: bytes, end: bool = True) -> bytes:
    return b"".join(compress_block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)) + END * end


def block_size(head: bytes) -> int:
    """Length of the block that begins with ``head`` (18 bytes or more); 0 if it is none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at < 12 + extra:
        tag, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC":
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def blocks(stream, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(file offset, content) of each block of a stream that stands at offset ``at``."""
    while head := stream.read(18):
        size = block_size(head)
        if not size:
            raise ValueError("not a block gzip file")
        body = head + stream.read(size - 18)
        extra = struct.unpack_from("<H", body, 10)[0]
        data = zlib.decompress(body[12 + extra : -8], -15)
        if zlib.crc32(data) != struct.unpack_from("<I", body, size - 8)[0]:
            raise ValueError(f"damaged block at {at}")
        yield at, data
        at += size


def next_block(raw: bytes, least: int = 0) -> int:
    """The first place from ``least`` on where a block begins, and another (or nothing) behind
    it; -1 if there is none."""
    at = raw.find(b"\x1f\x8b\x08\x04", least)
    while at >= 0:
        size = block_size(raw[at : at + 64])
        if size and (at + size >= len(raw) or raw[at + size : at + size + 4] == b"\x1f\x8b\x08\x04"[: len(raw) - at - size]):
            return at
        at = raw.find(b"\x1f\x8b\x08\x04", at + 1)
    return -1


def block_index(stream) -> list[tuple[int, int]]:
    """(file offset, content offset) of every block; only block heads and sizes are read."""
    out, at, place = [], 0, 0
    while True:
        stream.seek(at)
        head = stream.read(64)
        size = block_size(head)
        if not size:
            return out
        out.append((at, place))
        stream.seek(at + size - 4)
        place += struct.unpack("<I", stream.read(4))[0]
        at += size


def read_at(stream, virtual: int, size: int) -> bytes:
    """``size`` bytes of content from a virtual offset (file offset of a block, place in it) on."""
    stream.seek(virtual >> 16)
    out, skip = b"", virtual & 0xFFFF
    for _, data in blocks(stream, virtual >> 16):
        out += data[skip:]
        skip = 0
        if len(out) >= size:
            break
    return out[:size]


def read_indexed(stream, index: list[tuple[int, int]], offset: int, size: int) -> bytes:
    """Bytes [offset, offset + size) of the content, from the block that holds the first on."""
    k = max(0, bisect.bisect_right(index, offset, key=lambda e: e[1]) - 1)
    if not index:
        return b""
    stream.seek(index[k][0])
    out, skip = b"", offset - index[k][1]
    for _, data in blocks(stream, index[k][0]):
        out += data
        if len(out) >= skip + size:
            break
    return out[skip : skip + size]


def read_range(stream, offset: int, size: int) -> bytes:
    """Bytes [offset, offset + size) of the content."""
    out, place = [], 0
    for _, data in blocks(stream):
        if place + len(data) > offset and place < offset + size:
            out.append(data[max(0, offset - place) : offset + size - place])
        place += len(data)
        if place >= offset + size:
            break
    return b"".join(out)


def write_table(table: DataFrame, path: str, order: list[str]) -> None:
    """Write rows as tab-separated block-gzip part files in global order (the parts, one
    after the other, are one valid file)."""
    from pyarrow import fs

    lines = table.orderBy(*order).select(F.concat_ws("\t", *table.columns).alias("line"))

    def run(index, rows):
        files, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        files.create_dir(root, recursive=True)
        final, draft = f"{root}/part-{index:05d}.gz", f"{root}/.part-{index:05d}.draft"
        with files.open_output_stream(draft, compression=None) as out:
            data = bytearray()
            for r in rows:
                data += r.line.encode() + b"\n"
                while len(data) >= BLOCK:
                    out.write(compress_block(bytes(data[:BLOCK])))
                    del data[:BLOCK]
            if data:
                out.write(compress_block(bytes(data)))
            out.write(END)
        files.move(draft, final)
        return iter([])

    lines.rdd.mapPartitionsWithIndex(run).count()
