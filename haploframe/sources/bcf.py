"""BCF records: their bytes to the texts of a VCF's columns and back, and finding where records begin.

Texts are those that a VCF of the same records would hold in its first nine columns and its genotypes; INFO, FILTER and
other formats are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed values of the format: sizes and struct codes of its types, missing and end-of-vector integers by size.
INTEGERS = {1: (1, "b"), 2: (2, "h"), 3: (4, "i")}
MISSING = {1: -128, 2: -32768, 3: -2147483648}
END = {1: -127, 2: -32767, 3: -2147483647}
NO_QUAL = 0x7F800001
MAGIC = b"BCF\2"


#: Records in a row that must follow from a place before it counts as a record's begin.
CHAIN = 4
#: Sizes, sequence, position, extent, quality, numbers of alleles and formats of a record.
SITE = "<IIiiIIII"


@dataclass
class Header:
    """size: bytes of a BCF before its first record."""

    samples: list[str]
    contigs: list[str]
    text: str = ""
    size: int = 0

    def __post_init__(self):
        self.contig, self.keys = names_of(self.text)


def inflated(data: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of all members of a gzip file, in parts."""
    z = zlib.decompressobj(31)
    for part in data:
        while part:
            if out := z.decompress(part):
                yield out
            part = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def parse_header(text: str, size: int = 0) -> Header:
    names = [x.split() for x in text.splitlines() if x.startswith("#CHROM")]
    return Header(names[0][9:] if names else [], [m[1] for x in text.splitlines() if (m := re.match(r"##contig=<.*?ID=([^,>]+)", x))], text, size)


def text_header(data: Iterator[bytes]) -> Header | None:
    """The header of a VCF from its beginning; None if there is no #CHROM line before the records."""
    held = bytearray()
    for part in data:
        held += part
        lines = held.split(b"\n")
        whole = lines[:-1]
        k = next((i for i, x in enumerate(whole) if x[:1] != b"#" or x.startswith(b"#CHROM")), None)
        if k is not None:
            return parse_header(b"\n".join(x.rstrip(b"\r") for x in whole[: k + 1]).decode() + "\n") if whole[k].startswith(b"#CHROM") else None
    return parse_header(held.decode() + "\n") if b"#CHROM" in held and held.startswith(b"#") else None


def read_header(data: Iterator[bytes]) -> Header:
    """The header of a BCF from its beginning."""
    held = bytearray()
    for part in data:
        held += part
        if len(held) >= 9 and held[:4] != MAGIC:
            break
        if len(held) >= 9 and len(held) >= 9 + (n := struct.unpack_from("<I", held, 5)[0]):
            return parse_header(held[9 : 9 + n].rstrip(b"\0").decode(), 9 + n)
    raise ValueError("no BCF2 file")


def names_of(text: str) -> tuple[dict[int, str], dict[int, str]]:
    """Contigs and keys (FILTER, INFO and FORMAT ids) by their numbers: IDX, or their order with PASS first."""
    contigs: dict[int, str] = {}
    keys = {0: "PASS"}
    for kind, body in re.findall(r"^##(contig|FILTER|INFO|FORMAT)=<(.*)>$", text, re.M):
        name, own = re.search(r"(?:^|,)ID=([^,]+)", body), re.search(r",IDX=(\d+)", body)
        table = contigs if kind == "contig" else keys
        if name and name[1] not in table.values():
            table[int(own[1]) if own else max(table, default=-1) + 1] = name[1]
    return contigs, keys


def typed(data: bytes, at: int) -> tuple[int, int, int]:
    """Type and length of a typed value, and where its contents begin."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        sub, _, at = typed(data, at)
        size, code = INTEGERS[sub]
        (n,) = struct.unpack_from(f"<{code}", data, at)
        at += size
    return kind, n, at


def string(data: bytes, at: int) -> tuple[str, int]:
    _, n, at = typed(data, at)
    return data[at : at + n].decode(), at + n


def genotype(values: tuple[int, ...], kind: int) -> str:
    """The VCF text of one sample's GT."""
    out = ""
    for i, v in enumerate(values):
        if v == END[kind]:
            break
        allele = "." if v == MISSING[kind] or v >> 1 == 0 else str((v >> 1) - 1)
        out += (("|" if v & 1 else "/") if i else "") + allele
    return out or "."


def cells_of(data: bytes, at: int, samples: int, n: int, kind: int) -> pa.Array:
    """The texts of all samples' GT; each distinct one is made once."""
    size, _ = INTEGERS[kind]
    values = np.frombuffer(data, f"<i{size}", samples * n, at).reshape(samples, n)
    if not n:
        return pa.array(["."] * samples)
    rows, where = np.unique(values, axis=0, return_inverse=True) if n > 2 else packed_rows(values)
    return pa.array([genotype(tuple(r), kind) for r in rows.tolist()]).take(pa.array(where.ravel()))


def packed_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of one or two numbers, and each row's place among them."""
    wide = values.astype(np.int64)
    both = wide[:, 0] << 32 | (wide[:, -1] & 0xFFFFFFFF)
    found, where = np.unique(both, return_inverse=True)
    low = (found & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
    return np.stack((found >> 32, low), 1)[:, : values.shape[1]], where


def record(data: bytes, at: int, header: Header) -> tuple[list[str], pa.Array]:
    """CHROM, POS, ID, REF, ALT and QUAL of a record as texts, and its samples' GT."""
    shared, _, chrom, pos, _, quality, alleles, formats = struct.unpack_from(SITE, data, at)
    name, to = string(data, at + 32)
    names = []
    for _ in range(alleles >> 16):
        x, to = string(data, to)
        names.append(x)
    samples, cells, to = formats & 0xFFFFFF, None, at + 8 + shared
    for _ in range(formats >> 24):
        kind, _, to = typed(data, to)
        size, code = INTEGERS[kind]
        (key,) = struct.unpack_from(f"<{code}", data, to)
        kind, n, to = typed(data, to + size)
        if header.keys.get(key) == "GT":
            cells = cells_of(data, to, samples, n, kind)
        # Floats have four bytes, characters one.
        to += samples * n * {5: 4, 7: 1}.get(kind, INTEGERS.get(kind, (0, ""))[0])
    qual = "." if quality == NO_QUAL else f"{struct.unpack('<f', struct.pack('<I', quality))[0]:g}"
    return [header.contig[chrom], str(pos + 1), name or ".", names[0], ",".join(names[1:]) or ".", qual], cells if cells is not None else pa.array(["."] * samples)


def records(data: Iterator[bytes], header: Header, skip: int | None) -> Iterator[tuple[list[str], pa.Array]]:
    """All records of contents that begin with one, or with so many bytes before it."""
    held, at = bytearray(), skip or 0
    for part in data:
        held += part
        while len(held) - at >= 8 and len(held) - at >= (n := 8 + sum(struct.unpack_from("<II", held, at))):
            yield record(bytes(held[at : at + n]), 0, header)
            at += n
        if at <= len(held):
            del held[:at]
            at = 0


def may_begin(data: bytes, at: int, header: Header) -> int | None:
    """Where the next record begins if one begins here; None if none can."""
    if len(data) < at + 32:
        return None
    shared, own, chrom, pos, _, _, alleles, formats = struct.unpack_from(SITE, data, at)
    if shared < 26 or chrom not in header.contig or pos < -1 or formats & 0xFFFFFF != len(header.samples) or not alleles >> 16 or (formats >> 24) * len(header.samples) > own:
        return None
    # The name and the first allele are texts.
    try:
        kind, n, to = typed(data, at + 32)
        if n and kind != 7:
            return None
        kind, n, to = typed(data, to + n)
    except (IndexError, KeyError, struct.error):
        return None
    return at + 8 + shared + own if kind == 7 and n and to + n <= at + 8 + shared else None


def begin_of(data: bytes, header: Header, ended: bool) -> int | None:
    """The first place from which CHAIN records follow each other, or fewer up to the end of all data; None if more data is needed, -1 if there is none."""
    for at in range(len(data)):
        to, n = at, 0
        while n < CHAIN and to is not None and to < len(data):
            if len(data) - to < 96 and not ended:
                return None
            to, n = may_begin(data, to, header), n + 1
        if to is not None and (n == CHAIN or to == len(data) and ended):
            return at
        if to is not None and not ended:
            return None
    return -1 if ended else None


def owned(blocks: Iterator[tuple[int, bytes]], end: int, header: Header, skip: int | None) -> Iterator[tuple[list[str], pa.Array]]:
    """The records that begin in blocks before end. skip: bytes before the first record; None: the first blocks may begin inside a record."""
    # held are contents from some block on; where: the places in it from which on blocks begin at end or after it.
    held, at, limit = bytearray(), skip, None
    while True:
        while at is not None and at >= 0 and (limit is None or at < limit) and len(held) - at >= 8 and len(held) - at >= (n := 8 + sum(struct.unpack_from("<II", held, at))):
            yield record(bytes(held[at : at + n]), 0, header)
            at += n
        if at == -1 or at is not None and limit is not None and at >= limit:
            return
        if at:
            cut = min(at, len(held))
            del held[:cut]
            at, limit = at - cut, None if limit is None else limit - cut
        found = next(blocks, None)
        if found is None:
            if at is None:
                at = begin_of(bytes(held), header, True)
                continue
            return
        if limit is None and found[0] >= end:
            limit = len(held)
        held += found[1]
        if at is None:
            at = begin_of(bytes(held), header, False)
            if at is None and limit is not None and len(held) > limit + (1 << 26):
                raise ValueError("no record begins in 64 MB of a BCF")


def typed_value(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind, 0x13]) + struct.pack("<i", n)


def text_value(text: str) -> bytes:
    raw = text.encode()
    return typed_value(7, len(raw)) + raw


def encoded(line: str, header: Header) -> bytes:
    """The record of a VCF line: its first six columns, PASS, and the samples' GT."""
    chrom, pos, name, ref, alt, qual, _, _, form, *cells = line.split("\t")
    names = [ref, *([] if alt == "." else alt.split(","))]
    first = next(i for i, c in header.contig.items() if c == chrom)
    quality = NO_QUAL if qual == "." else struct.unpack("<I", struct.pack("<f", float(qual)))[0]
    calls = [re.split(r"([|/])", c.split(":", 1)[0]) for c in cells] if form.split(":")[0] == "GT" else []
    wide = max((len(c) + 1) // 2 for c in calls) if calls else 0
    values = np.full((len(calls), wide), END[2], np.int64)
    for i, c in enumerate(calls):
        for k, x in enumerate(c[::2]):
            values[i, k] = (0 if x == "." else int(x) + 1) << 1 | (k > 0 and c[2 * k - 1] == "|")
    kind = 1 if values.max(initial=0) < 120 else 2
    values[values == END[2]] = END[kind]
    key = next((i for i, k in header.keys.items() if k == "GT"), 1)
    own = typed_value(1, 1) + bytes([key]) + typed_value(kind, wide) + values.astype(f"<i{INTEGERS[kind][0]}").tobytes() if calls else b""
    shared = text_value("" if name == "." else name) + b"".join(map(text_value, names)) + typed_value(1, 1) + b"\0"
    site = struct.pack("<iiIIII", first, int(pos) - 1, len(ref), quality, len(names) << 16, bool(calls) << 24 | len(calls))
    return struct.pack("<II", len(site) + len(shared), len(own)) + site + shared + own


def header_bytes(text: str) -> bytes:
    raw = text.encode() + b"\0"
    return MAGIC + b"\2" + struct.pack("<I", len(raw)) + raw
