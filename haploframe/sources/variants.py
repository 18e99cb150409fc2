"""VCF and BCF files as Spark data sources: "vcf" and "bcf", to read and to write.

Reading: a partition is a run of a file's bytes, and a task reads the records that begin in it. In plain text it begins
after the first line end; in blocked gzip at the first block, and in a BCF also at the first place from which on records
follow each other. Other gzip files are one partition each. With a region (option ``region``, or with option
``filters`` what Spark pushes down of filters on chrom and pos, see spark.sql.python.filterPushdown.enabled) a file that has an index beside it (``.tbi``
or ``.csi``) is read by the index's chunks only. Rows come as Arrow batches, with the number of the partition and the
place in it, so that numbering the records needs counts of partitions (option ``counts``), not the records.

Writing: each task writes its rows, in order, as blocks to a file of its own below the target's folder, with an index of
them; the commit lays them behind one header, adds the block that ends a file, and puts the joined index beside it.

Options: path; region; split (bytes of a partition); strict (a record of under nine fields is an error, else left out);
counts; filters; wide. Files must be reachable from the tasks by pyarrow.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..config import ImputationError
from . import bcf, bgzf, index

FIXED = 9
#: Bytes of a partition, and decompressed bytes that become a batch.
SPLIT = 32 << 20
BATCH = 1 << 20
ROWS = "part int, row long, chrom string, pos long, id string, ref string, alt array<string>, qual double, fields array<string>"
COUNTS = "part int, n long"
#: With option wide the samples' fields come as bytes: "panel" an allele each (255 for a missing one; a call of one allele stands for both), "targets" a call each (see wide_cells).
WIDE = ROWS.replace("fields array<string>", "cells binary")
MISSING, ALONE = 255, 254
IS_ALLELE, ALLELE = np.zeros(256, bool), np.full(256, MISSING, np.uint8)
IS_ALLELE[[*b"0123456789."]] = True
ALLELE[[*b"0123456789"]] = range(10)
REGION = re.compile(r"([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?")
#: No position is beyond this.
LAST = 1 << 40


def region_of(text: str) -> tuple[str, int, int] | None:
    """Sequence, first and last position of chrom or chrom:start or chrom:start-end; None for an empty text."""
    if not text:
        return None
    m = REGION.fullmatch(text)
    if not m:
        raise ImputationError(f"no region {text!r}")
    number = lambda x, default: int(x.replace(",", "")) if x else default
    return m[1], number(m[2], 0), number(m[3], LAST)


@dataclass
class Part(InputPartition):
    """A run of a file. kind: text, blocked, gzip; begin and end are bytes, or virtual offsets with exact."""

    number: int
    path: str
    kind: str
    begin: int
    end: int
    exact: bool = False


def pieces(parts: Iterator[bytes], first: bool, beyond: Iterator[bytes]) -> Iterator[bytes]:
    """Whole lines that begin in parts: after the first line end unless first, and to the first line end beyond."""
    held, skip = bytearray(), not first
    for part in parts:
        if skip:
            i = part.find(b"\n")
            if i < 0:
                continue
            part, skip = part[i + 1 :], False
        held += part
        if len(held) >= BATCH and (cut := held.rfind(b"\n") + 1):
            yield bytes(held[:cut])
            del held[:cut]
    if skip:
        return
    for part in beyond:
        i = part.find(b"\n")
        held += part[: i + 1] if i >= 0 else part
        if i >= 0:
            break
    if held:
        yield bytes(held)


def between(source: bgzf.Source, begin: int, end: int) -> Iterator[bytes]:
    """The contents from one virtual offset to another."""
    last, cut = end >> 16, end & 0xFFFF
    for at, data in bgzf.blocks(source, begin >> 16, last + bool(cut)):
        data = data[:cut] if at == last else data
        yield data[begin & 0xFFFF :] if at == begin >> 16 else data


def lines_of(source: bgzf.Source, part: Part) -> Iterator[bytes]:
    """Whole lines of a partition, some at a time."""
    if part.exact:
        yield from pieces(between(source, part.begin, part.end), True, iter(()))
    elif part.kind == "text":
        yield from pieces(source.stream(part.begin, part.end), part.begin == 0, source.stream(part.end))
    elif part.kind == "gzip":
        yield from pieces(bcf.inflated(source.stream(0)), True, iter(()))
    else:
        at = bgzf.next_block(source, part.begin, part.end) if part.begin else 0
        if at is not None:
            yield from pieces((data for _, data in bgzf.blocks(source, at, part.end)), part.begin == 0, after(source, part.end))


def after(source: bgzf.Source, at: int) -> Iterator[bytes]:
    """The contents of the blocks that begin at a place or after it."""
    found = bgzf.next_block(source, at, source.size)
    return iter(()) if found is None else (data for _, data in bgzf.blocks(source, found))


def text_batches(source: bgzf.Source, part: Part, samples: int, strict: bool) -> Iterator[pa.RecordBatch]:
    """chrom to fields of the records."""
    for some in lines_of(source, part):
        lines = [x.removesuffix(b"\r").rstrip(b" ") for x in some.split(b"\n")]
        rows = pc.split_pattern(pa.array([x for x in lines if x and x[:1] != b"#"], pa.binary()).cast(pa.string()), "\t")
        if len(short := rows.filter(pc.less(pc.list_value_length(rows), FIXED))):
            if strict:
                raise ImputationError(f"a record of {part.path} has fewer than nine fields: {short[0].as_py()}")
            rows = rows.filter(pc.greater_equal(pc.list_value_length(rows), FIXED))
        if len(rows):
            yield columns([pc.list_element(rows, i) for i in (0, 1, 2, 3, 4, 5)], fields_of(rows, samples))


def fields_of(rows: pa.ListArray, samples: int) -> pa.ListArray:
    """The samples' texts of split records: a missing one at the end is a dot, more than there are samples are cut. A header that names no samples bounds nothing."""
    first = rows.offsets.to_numpy().astype(np.int64)
    first, sizes, flat = first[:-1] - first[0], np.diff(first), rows.flatten()
    if not samples:
        place = np.arange(len(flat)) - np.repeat(first, sizes)
        return lists(flat.filter(pa.array(place >= FIXED)), sizes - FIXED)
    place = np.arange(samples)[None, :] + FIXED
    take = first[:, None] + place
    if sizes.min(initial=samples + FIXED) >= samples + FIXED:
        return lists(flat.take(pa.array(take.ravel())), np.full(len(rows), samples))
    return lists(pc.fill_null(flat.take(pa.array(take.ravel(), mask=(place >= sizes[:, None]).ravel())), "."), np.full(len(rows), samples))


def alleles_in(text: str) -> tuple[int, int]:
    """The two alleles of a sample's field; ALONE for the second one of a call of one allele."""
    parts = re.split(r"[|/]", text.split(":", 1)[0], maxsplit=1)
    found = [min(int(m[0]), MISSING) if (m := re.match(r"\d+", x)) else MISSING for x in parts]
    return found[0], found[1] if len(found) > 1 else ALONE


def pairs_of_line(tail: bytes, samples: int) -> np.ndarray | None:
    """samples x 2 alleles where each field is a call of two digits or dots; None for other lines."""
    if len(tail) != 4 * samples - 1:
        return None
    x = np.frombuffer(tail + b"\t", np.uint8).reshape(samples, 4)
    plain = IS_ALLELE[x[:, 0]].all() and IS_ALLELE[x[:, 2]].all() and ((x[:, 1] == 124) | (x[:, 1] == 47)).all() and (x[:, 3] == 9).all()
    return ALLELE[x[:, ::2]] if plain else None


def pairs_of_texts(cells: pa.Array) -> np.ndarray:
    """The same of any texts; each distinct one is looked at once."""
    d = cells.dictionary_encode()
    known = np.array([alleles_in(x) for x in d.dictionary.to_pylist()], np.uint8).reshape(-1, 2)
    return known[d.indices.to_numpy()]


def wide_cells(pairs: np.ndarray, wide: str) -> bytes:
    """The alleles of a panel's record, or of targets a byte for each call: its alleles as halves, 15 for one that is missing or not below 10; a call of one allele is missing."""
    a, b = pairs[:, 0], pairs[:, 1]
    if wide == "panel":
        return np.stack((a, np.where(b == ALONE, a, b)), 1).tobytes()
    half = lambda x: np.where(x < 10, x, 15).astype(np.uint8)
    return np.where(b == ALONE, 255, half(a) << 4 | half(b)).astype(np.uint8).tobytes()


def wide_batches(source: bgzf.Source, part: Part, samples: int, strict: bool, wide: str) -> Iterator[pa.RecordBatch]:
    """chrom to qual and cells of the records of a text."""
    for some in lines_of(source, part):
        fixed, cells = [], []
        for line in some.split(b"\n"):
            line = line.removesuffix(b"\r").rstrip(b" ")
            if not line or line[:1] == b"#":
                continue
            parts = line.split(b"\t", FIXED)
            if len(parts) < FIXED:
                if strict:
                    raise ImputationError(f"a record of {part.path} has fewer than nine fields: {line[:80].decode()}")
                continue
            tail = parts[FIXED] if len(parts) > FIXED else b""
            pairs = pairs_of_line(tail, samples) if samples else None
            if pairs is None:
                texts = tail.decode().split("\t") if tail else []
                pairs = pairs_of_texts(pa.array((texts + ["."] * samples)[: samples or len(texts)], pa.string()))
            fixed.append([x.decode() for x in parts[:6]]), cells.append(wide_cells(pairs, wide))
        if fixed:
            yield columns([pa.array(c, pa.string()) for c in zip(*fixed)], pa.array(cells, pa.binary()), "cells")


def lists(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)


def number(text: str) -> float | None:
    try:
        return 0.0 if text == "." else float(text)
    except ValueError:
        return None


def columns(fixed: list, fields: pa.Array, last: str = "fields") -> pa.RecordBatch:
    """chrom, pos, id, ref, alt, qual and fields (or cells) from the texts of the columns."""
    chrom, pos, name, ref, alt, qual = fixed
    return pa.RecordBatch.from_arrays([chrom, pc.cast(pos, pa.int64()), name, ref, pc.split_pattern(alt, ","), pa.array([number(x) for x in qual.to_pylist()], pa.float64()), fields], ["chrom", "pos", "id", "ref", "alt", "qual", last])


def bcf_batches(source: bgzf.Source, part: Part, header: bcf.Header, wide: str) -> Iterator[pa.RecordBatch]:
    """chrom to fields of the records that begin in a partition."""
    if part.exact:
        data = between(source, part.begin, part.end)
        found = bcf.records(data, header, None)
    elif part.kind == "gzip":
        found = bcf.records(bcf.inflated(source.stream(0)), header, header.size)
    elif part.kind == "text":
        found = bcf.records(source.stream(0), header, header.size)
    else:
        at = bgzf.next_block(source, part.begin, part.end) if part.begin else 0
        if at is None:
            return
        found = bcf.owned(bgzf.blocks(source, at), part.end, header, header.size if part.begin == 0 else None)
    fixed, cells, n = [], [], 0
    for texts, own in found:
        fixed.append(texts), cells.append(own)
        n += len(own)
        if n >= BATCH >> 3:
            yield bcf_batch(fixed, cells, wide)
            fixed, cells, n = [], [], 0
    if fixed:
        yield bcf_batch(fixed, cells, wide)


def bcf_batch(fixed: list, cells: list, wide: str) -> pa.RecordBatch:
    if wide:
        return columns([pa.array(c, pa.string()) for c in zip(*fixed)], pa.array([wide_cells(pairs_of_texts(c), wide) for c in cells], pa.binary()), "cells")
    return columns([pa.array(c, pa.string()) for c in zip(*fixed)], lists(pa.concat_arrays(cells), np.array([len(c) for c in cells])))


class VariantReader(DataSourceReader):
    def __init__(self, options: dict, form: str):
        self.path, self.form, self.split = options["path"], form, int(options.get("split", SPLIT))
        self.strict, self.counts = (options.get(k, d).lower() == "true" for k, d in (("strict", "true"), ("counts", "false")))
        self.region, self.wide = region_of(options.get("region", "")), options.get("wide", "")
        self.system, _ = bgzf.file_system(self.path)
        self.files = bgzf.files_of(self.path)
        if not self.files:
            raise ImputationError(f"{self.path} holds no file")
        self.header = header_of(self.system, [p for p, _ in self.files], form)
        self.pushed = self.region

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        for path, size in self.files:
            source = bgzf.Source(self.system, path)
            blocked = bgzf.is_blocked(source)
            kind = "blocked" if blocked else "gzip" if source.read(0, 2) == bgzf.MAGIC[:2] else "text"
            if blocked and self.pushed and (found := self.indexed(path)):
                name, low, high = self.pushed
                out += [Part(0, path, kind, x, y, True) for x, y in found.region(name, max(0, low - 1), high, self.split)]
            elif kind == "gzip" or kind == "text" and self.form == "bcf":
                out.append(Part(0, path, kind, 0, size))
            else:
                out += [Part(0, path, kind, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        for i, p in enumerate(out):
            p.number = i
        # Spark plans no scan without partitions.
        return out or [Part(0, self.files[0][0], "none", 0, 0)]

    def indexed(self, path: str) -> index.Index | None:
        for end in (".tbi", ".csi"):
            if self.system.get_file_info(path + end).type == fs.FileType.File:
                source = bgzf.Source(self.system, path + end)
                return index.parse(b"".join(source.stream(0)), self.header.contigs)
        return None

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.kind == "none":
            return
        source = bgzf.Source(self.system, part.path)
        samples = len(self.header.samples)
        if self.form == "bcf":
            found = bcf_batches(source, part, self.header, self.wide)
        else:
            found = wide_batches(source, part, samples, self.strict, self.wide) if self.wide else text_batches(source, part, samples, self.strict)
        for b in found:
            if self.region:
                name, low, high = self.region
                b = b.filter(pc.and_(pc.equal(b["chrom"], name), pc.and_(pc.greater_equal(b["pos"], low), pc.less_equal(b["pos"], high))))
            if len(b):
                yield b

    def count(self, part: Part) -> int:
        """Records of a partition; lines of text aren't parsed for it."""
        if self.form == "bcf" or self.region or not self.strict or part.kind == "none":
            return sum(map(len, self.batches(part)))
        own = (x for some in lines_of(bgzf.Source(self.system, part.path), part) for x in some.split(b"\n"))
        return sum(1 for x in own if x.rstrip(b"\r ") and x[:1] != b"#")

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        n = 0
        if self.counts:
            yield pa.RecordBatch.from_arrays([pa.array([part.number], pa.int32()), pa.array([self.count(part)])], ["part", "n"])
            return
        for b in self.batches(part):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), part.number, np.int32)), pa.array(np.arange(n, n + len(b))), *b.columns], ["part", "row", *b.schema.names])
            n += len(b)


class FilteredReader(VariantReader):
    """Takes filters on chrom and pos, where Spark is set to push them down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters choose what is read, and Spark applies all of them again."""
        chrom, low, high = None, 0, LAST
        for f in filters:
            match f:
                case EqualTo(("chrom",), str(x)):
                    chrom = x
                case EqualTo(("pos",), int(x)):
                    low, high = max(low, x), min(high, x)
                case GreaterThanOrEqual(("pos",), int(x)) | GreaterThan(("pos",), int(x)):
                    low = max(low, x)
                case LessThanOrEqual(("pos",), int(x)) | LessThan(("pos",), int(x)):
                    high = min(high, x)
            yield f
        if chrom is not None and self.region is None:
            self.pushed = chrom, low, high


def header_of(system: fs.FileSystem, paths: list[str], form: str) -> bcf.Header:
    """The header of the first of the files that has one."""
    for path in paths:
        source = bgzf.Source(system, path)
        raw = source.stream(0)
        data = bcf.inflated(raw) if source.read(0, 2) == bgzf.MAGIC[:2] else raw
        found = bcf.read_header(data) if form == "bcf" else bcf.text_header(data)
        if found:
            return found
    raise ImputationError(f"{paths[0]} has no #CHROM line")


class Message(WriterCommitMessage):
    def __init__(self, path: str, size: int, rows: int, sequences: dict):
        self.path, self.size, self.rows, self.sequences = path, size, rows, sequences


class VariantWriter(DataSourceArrowWriter):
    """Writes lines (VCF records, in order of partitions) as one blocked file at path with an index beside it."""

    def __init__(self, options: dict, form: str):
        self.path, self.form, self.header = options["path"], form, options["header"]
        self.system, self.inner = bgzf.file_system(self.path)
        self.parts = f"{self.inner}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Message:
        self.system.create_dir(self.parts, recursive=True)
        path, known, builder, rows = f"{self.parts}/{uuid.uuid4().hex}", bcf.parse_header(self.header), index.Builder(), 0
        with self.system.open_output_stream(path) as out:
            blocks = bgzf.Blocks(out)
            for batch in iterator:
                for line in batch["line"].to_pylist():
                    chrom, pos, _, ref, _ = line.split("\t", 4)
                    at = blocks.place
                    piece = bcf.encoded(line, known) if self.form == "bcf" else line.encode() + b"\n"
                    if blocks.held and len(blocks.held) + len(piece) > bgzf.FULL:
                        blocks.flush()
                        at = blocks.place
                    blocks.write(piece)
                    builder.add(chrom, int(pos) - 1, int(pos) - 1 + len(ref), at, blocks.place)
                    rows += 1
            blocks.flush()
        return Message(path, blocks.at, rows, builder.sequences)

    def commit(self, messages: list[Message | None]) -> None:
        found = [m for m in messages if m is not None and m.rows]
        head = self.header.encode()
        if self.form == "bcf":
            head = bcf.header_bytes(self.header)
        first = b"".join(bgzf.block_of(head[i : i + bgzf.FULL]) for i in range(0, len(head), bgzf.FULL))
        at, parts = len(first), []
        target = f"{self.parts}/whole"
        self.system.create_dir(self.parts, recursive=True)
        with self.system.open_output_stream(target) as out:
            out.write(first)
            for m in found:
                built = index.Builder()
                built.sequences = m.sequences
                parts.append(built.shifted(at))
                # Blocks are copied as they are, a step at a time.
                for some in bgzf.Source(self.system, m.path).stream(0):
                    out.write(some)
                at += m.size
            out.write(bgzf.END)
        both = index.joined(parts)
        data, end = (index.csi(both, bcf.parse_header(self.header).contigs), ".csi") if self.form == "bcf" else (index.tbi(both), ".tbi")
        self.system.move(target, self.inner)
        with self.system.open_output_stream(self.inner + end) as out:
            out.write(data)
        self.system.delete_dir(self.parts)

    def abort(self, messages: list[Message | None]) -> None:
        if self.system.get_file_info(self.parts).type == fs.FileType.Directory:
            self.system.delete_dir(self.parts)


class VcfSource(DataSource):
    FORM = "vcf"

    @classmethod
    def name(cls) -> str:
        return cls.FORM

    def schema(self) -> str:
        return COUNTS if self.options.get("counts", "false").lower() == "true" else WIDE if self.options.get("wide") else ROWS

    def reader(self, schema) -> VariantReader:
        return (FilteredReader if self.options.get("filters", "false").lower() == "true" else VariantReader)(dict(self.options), self.FORM)

    def writer(self, schema, overwrite: bool) -> VariantWriter:
        return VariantWriter(dict(self.options), self.FORM)


class BcfSource(VcfSource):
    FORM = "bcf"


def register(spark) -> None:
    spark.dataSource.register(VcfSource)
    spark.dataSource.register(BcfSource)
