"""Binning indexes of blocked files (TBI and CSI): reading, planning a region's chunks, building and writing.

A sequence is cut into bins of several levels, each level's bins eight times as wide as the next one's; a record is in
the smallest bin that holds its whole extent. The index lists, for each bin, chunks of the file (from one virtual
offset to another) that hold its records, and for stretches of 16 kb, or for each bin, the offset of the first record
that reaches it.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field

from . import bgzf

# Fixed values of the formats: the width of TBI's smallest bins as a power of two, its levels, and its settings for VCF.
SHIFT, DEPTH = 14, 5
VCF_SETTINGS = (2, 1, 2, 0, ord("#"), 0)


def first_bin(level: int) -> int:
    return ((1 << 3 * level) - 1) // 7


def bins_over(begin: int, end: int, shift: int = SHIFT, depth: int = DEPTH) -> list[range]:
    """The bins of each level that overlap [begin, end)."""
    end = min(end, 1 << shift + 3 * depth) - 1
    return [range(first_bin(k) + (begin >> shift + 3 * (depth - k)), first_bin(k) + (end >> shift + 3 * (depth - k)) + 1) for k in range(depth + 1)] if begin <= end else []


def bin_of(begin: int, end: int, shift: int = SHIFT, depth: int = DEPTH) -> int:
    """The smallest bin that holds [begin, end)."""
    return next(b[0] for b in reversed(bins_over(begin, max(end, begin + 1), shift, depth)) if len(b) == 1)


@dataclass
class Sequence:
    """chunks: by bin, (from, to) virtual offsets. least: by bin (CSI) or by 16 kb (TBI), the first offset that reaches it."""

    chunks: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    least: dict[int, int] = field(default_factory=dict)


@dataclass
class Index:
    names: list[str]
    sequences: list[Sequence]
    shift: int = SHIFT
    depth: int = DEPTH
    linear: bool = True

    def region(self, name: str, begin: int, end: int, most: int = 1 << 25) -> list[tuple[int, int]]:
        """The file's chunks, in order and apart from each other, that hold all records of [begin, end) of a sequence. Neighbours become one of up to most bytes."""
        if name not in self.names or (k := self.names.index(name)) >= len(self.sequences):
            return []
        s, low = self.sequences[k], 0
        if self.linear:
            low = s.least.get(begin >> self.shift, 0)
        else:
            b = first_bin(self.depth) + (begin >> self.shift)
            # The smallest bin there is that holds the begin.
            while b and b not in s.least:
                b = (b - 1) >> 3
            low = s.least.get(b, 0)
        found = sorted((max(x, low), y) for bins in bins_over(begin, end, self.shift, self.depth) for b in (bins if len(bins) < len(s.chunks) else [b for b in s.chunks if b in bins]) for x, y in s.chunks.get(b, ()) if y > low)
        out: list[tuple[int, int]] = []
        for x, y in found:
            # Chunks that meet in a block, or with no more than one between them, are read at once.
            gap = (x >> 16) - (out[-1][1] >> 16) if out else 0
            if out and (gap <= 0 or gap <= bgzf.LARGEST and (y >> 16) - (out[-1][0] >> 16) <= most):
                out[-1] = out[-1][0], max(out[-1][1], y)
            else:
                out.append((x, y))
        return out


def contents(data: bytes) -> bytes:
    out = []
    while data:
        n = bgzf.block_size(data)
        if n is None:
            raise ValueError("an index is a blocked file")
        out.append(bgzf.inflate(data[:n]))
        data = data[n:]
    return b"".join(out)


def names_of(raw: bytes) -> list[str]:
    return [x.decode() for x in raw.split(b"\0")[:-1]]


def parse(data: bytes, contigs: list[str] | None = None) -> Index:
    """An index from its file's bytes. contigs: the names of sequences, which the index of a BCF doesn't hold."""
    data = contents(data)
    kind, at = data[:4], 4

    def take(form: str) -> tuple:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))

    if kind == b"TBI\1":
        sequences, *_, size = take("<i6ii")
        names = names_of(data[at : at + size])
        at += size
        out = Index(names, [])
        for _ in range(sequences):
            s = Sequence()
            for _ in range(take("<i")[0]):
                b, n = take("<Ii")
                s.chunks[b] += [take("<QQ") for _ in range(n)]
            s.least = {i: x for i, x in enumerate(take(f"<{take('<i')[0]}Q")) if x}
            out.sequences.append(s)
        return out
    if kind != b"CSI\1":
        raise ValueError("neither a TBI nor a CSI index")
    shift, depth, size = take("<iii")
    aux = data[at : at + size]
    at += size
    names = names_of(aux[28:]) if size > 28 else contigs or []
    out = Index(names, [], shift, depth, False)
    for _ in range(take("<i")[0]):
        s = Sequence()
        for _ in range(take("<i")[0]):
            b, low, n = take("<IQi")
            s.chunks[b] += [take("<QQ") for _ in range(n)]
            s.least[b] = low
        # A pseudo-bin beyond the last level holds counts.
        limit = first_bin(depth + 1)
        out.sequences.append(Sequence(defaultdict(list, {b: c for b, c in s.chunks.items() if b < limit}), {b: x for b, x in s.least.items() if b < limit}))
    return out


class Builder:
    """Collects records in file order: sequence, extent and virtual offsets."""

    def __init__(self):
        self.sequences: dict[str, Sequence] = {}

    def add(self, name: str, begin: int, end: int, at: int, to: int) -> None:
        s = self.sequences.setdefault(name, Sequence())
        chunks = s.chunks[bin_of(begin, end)]
        if chunks and chunks[-1][1] == at:
            chunks[-1] = chunks[-1][0], to
        else:
            chunks.append((at, to))
        for k in range(begin >> SHIFT, (max(end, begin + 1) - 1 >> SHIFT) + 1):
            s.least.setdefault(k, at)

    def shifted(self, bytes_before: int) -> dict[str, Sequence]:
        """As it is when so many bytes of the file stand before."""
        up = bytes_before << 16
        return {n: Sequence(defaultdict(list, {b: [(x + up, y + up) for x, y in c] for b, c in s.chunks.items()}), {k: x + up for k, x in s.least.items()}) for n, s in self.sequences.items()}


def joined(parts: list[dict[str, Sequence]]) -> dict[str, Sequence]:
    """The index of files laid end to end."""
    out: dict[str, Sequence] = {}
    for part in parts:
        for name, s in part.items():
            whole = out.setdefault(name, Sequence())
            for b, c in s.chunks.items():
                whole.chunks[b] += c
            for k, x in s.least.items():
                whole.least.setdefault(k, x)
    return out


def packed(text: bytes) -> bytes:
    return b"".join(bgzf.block_of(text[i : i + bgzf.FULL]) for i in range(0, len(text), bgzf.FULL)) + bgzf.END


def tbi(sequences: dict[str, Sequence]) -> bytes:
    names = b"".join(n.encode() + b"\0" for n in sequences)
    out = [b"TBI\1", struct.pack("<i6ii", len(sequences), *VCF_SETTINGS, len(names)), names]
    for s in sequences.values():
        out.append(struct.pack("<i", len(s.chunks)))
        for b in sorted(s.chunks):
            out += [struct.pack("<Ii", b, len(s.chunks[b])), *(struct.pack("<QQ", *c) for c in s.chunks[b])]
        offsets, last = [], 0
        for k in range(max(s.least, default=-1) + 1):
            # Where nothing begins the stretch takes the offset of the one before.
            last = s.least.get(k, last)
            offsets.append(last)
        out.append(struct.pack(f"<i{len(offsets)}Q", len(offsets), *offsets))
    return packed(b"".join(out))


def csi(sequences: dict[str, Sequence], contigs: list[str]) -> bytes:
    """An index for a BCF, whose sequences are the contigs of its header."""
    out = [b"CSI\1", struct.pack("<iiii", SHIFT, DEPTH, 0, len(contigs))]
    for name in contigs:
        s = sequences.get(name, Sequence())
        out.append(struct.pack("<i", len(s.chunks)))
        for b in sorted(s.chunks):
            level = next(k for k in range(DEPTH, -1, -1) if b >= first_bin(k))
            begin = b - first_bin(level) << 3 * (DEPTH - level)
            low = min((x for k, x in s.least.items() if begin <= k < begin + (1 << 3 * (DEPTH - level))), default=0)
            out += [struct.pack("<IQi", b, low, len(s.chunks[b])), *(struct.pack("<QQ", *c) for c in s.chunks[b])]
    return packed(b"".join(out))
