"""Blocked gzip (BGZF): finding, reading and writing its blocks, and files read by place.

A file is a run of gzip members of at most 64 KB that tell their own size, so that reading can begin at any of them. A
place in the decompressed contents is a virtual offset: a block's place in the file times 65,536, plus the place in it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs

# Fixed values of the format: how a block begins, the empty block that ends a file, the contents of a full block.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FULL = 65280
LARGEST = 65536
#: Bytes of a file read at once.
STEP = 1 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether tasks can open the path themselves; stores that only Spark's readers know can't be."""
    try:
        system, inner = file_system(path)
        return system.get_file_info(inner).type != fs.FileType.NotFound
    except (ValueError, OSError, NotImplementedError):
        return False


def files_of(path: str) -> list[tuple[str, int]]:
    """Path in its file system and size of a file, or of the files of a folder by name; hidden ones are left out."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(inner, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class Source:
    """A file read by place; remembers how many bytes were read."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        self.size, self.bytes_read = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        self.bytes_read += n
        return self.file.read_at(n, at) if n else b""

    def stream(self, at: int, end: int | None = None) -> Iterator[bytes]:
        end = self.size if end is None else min(end, self.size)
        while at < end:
            part = self.read(at, min(STEP, end - at))
            yield part
            at += len(part)


def block_size(head: bytes, at: int = 0) -> int | None:
    """Bytes of the block whose header begins at a place of head; None if none does."""
    if head[at : at + 4] != MAGIC or len(head) < at + 18:
        return None
    (extra,) = struct.unpack_from("<H", head, at + 10)
    i, end = at + 12, min(at + 12 + extra, len(head))
    while i + 4 <= end:
        name, n = head[i : i + 2], struct.unpack_from("<H", head, i + 2)[0]
        if name == b"BC" and n == 2 and i + 6 <= end:
            return struct.unpack_from("<H", head, i + 4)[0] + 1
        i += 4 + n
    return None


def is_blocked(source: Source) -> bool:
    return block_size(source.read(0, 64)) is not None


def next_block(source: Source, at: int, end: int) -> int | None:
    """Where the first block at a place or after it begins, before end: its size leads to another block or to the file's end."""
    while at < end:
        window = source.read(at, 2 * LARGEST + 64)
        i = window.find(MAGIC)
        while 0 <= i < end - at:
            n = block_size(window, i)
            if n and (at + i + n == source.size or block_size(window[i + n : i + n + 64] or source.read(at + i + n, 64)) is not None):
                return at + i
            i = window.find(MAGIC, i + 1)
        at += max(1, len(window) - 64)
    return None


def inflate(block: bytes) -> bytes:
    return zlib.decompress(block, 31)


def blocks(source: Source, at: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Place and contents of the blocks from one on that begin before end."""
    end, held, base = source.size if end is None else end, b"", at
    while at < min(end, source.size):
        if at + 64 > base + len(held) or (block_size(held, at - base) or 0) > base + len(held) - at:
            held, base = source.read(at, max(STEP if end - at > STEP else min(end - at, STEP) + LARGEST, LARGEST)), at
        n = block_size(held, at - base)
        if n is None:
            raise ValueError(f"no block begins at {at}")
        yield at, inflate(held[at - base : at - base + n])
        at += n


def block_of(contents: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(contents) + z.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(contents), len(contents))


class Blocks:
    """Writes contents as blocks to a file object and tells where each piece stands."""

    def __init__(self, out):
        self.out, self.at, self.held = out, 0, bytearray()

    @property
    def place(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, piece: bytes) -> None:
        # A piece that fits into one block isn't cut.
        if self.held and len(self.held) + len(piece) > FULL:
            self.flush()
        self.held += piece
        while len(self.held) >= FULL:
            self.put(bytes(self.held[:FULL]))
            del self.held[:FULL]

    def put(self, contents: bytes) -> None:
        block = block_of(contents)
        self.out.write(block)
        self.at += len(block)

    def flush(self) -> None:
        if self.held:
            self.put(bytes(self.held))
            self.held.clear()
