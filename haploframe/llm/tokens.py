"""Words and hashes of whole Arrow text columns by NumPy, for functions that run on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space, tab, line feed, vertical tab, form feed and carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null is empty text. Runs hold limit bytes, or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte begin and end of all words, and for each text the number of its first word (one more entry at the end)."""
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text's first and last byte bound words even where the neighbouring text has no space.
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads] = inside[heads]
    ends[tails] = inside[tails]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return b, e, np.searchsorted(b, offsets)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from running sums of a polynomial of its bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[begins]) * powers(BASE_INVERSE, len(data) + 1)[begins] + (ends - begins).astype(np.uint64))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k hashes in a row, over text boundaries too."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= BASE
        h += items[j : j + n]
    return mix(h)


def content_keys(contents: list[bytes], step: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each content, some contents of step bytes or one longer one at a time."""
    size = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(size)
    out, at = np.empty(len(contents), np.uint64), 0
    while at < len(contents):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + step, "right")))
        data, n = np.frombuffer(b"".join(contents[at:to]), np.uint8), size[at:to]
        begin = np.cumsum(n) - n
        place = np.arange(len(data)) - np.repeat(begin, n)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, int(n.max()))[place], out=sums[1:])
        out[at:to] = mix(sums[begin + n] - sums[begin] + n.astype(np.uint64))
        at = to
    return out
