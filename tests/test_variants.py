"""VCF and BCF files: splits, blocks, indexes, short records, and writing."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from haploframe.config import HMMParameters, ImputationConfig, ImputationError
from haploframe.plans.impute import impute
from haploframe.sources import bcf, bgzf, index, variants, vcf

SAMPLES = [f"S{i}" for i in range(9)]


def made(n=700, seed=3):
    """Record lines over two sequences, with long references, some far apart, and calls of all kinds."""
    r = random.Random(seed)
    out = []
    for chrom, count in (("chr1", n), ("chr2", n // 2)):
        pos = 1
        for i in range(count):
            pos += r.choice((1, 3, 900, 20_000, 300_000))
            ref = "A" * r.choice((1, 1, 1, 50, 40_000 if i % 97 == 0 else 2))
            cells = [r.choice(("0|0", "0|1", "1|1", "./.", "2/1", ".", "1")) + r.choice(("", ":7")) for _ in SAMPLES]
            out.append("\t".join([chrom, str(pos), r.choice((".", f"rs{i}")), ref, r.choice(("G", "G,T", ".")), r.choice((".", "30")), "PASS", ".", "GT:DP", *cells]))
    return out


def plain(cell):
    return cell.split(":")[0]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d, lines = tmp_path_factory.mktemp("variants"), made()
    head = vcf.header_lines(SAMPLES, ["chr1", "chr2"])
    (d / "p.vcf").write_text("\n".join(head + lines) + "\n")
    (d / "r.vcf").write_text("\r\n".join(head + lines))
    with gzip.open(d / "g.vcf.gz", "wb") as f:
        f.write((d / "p.vcf").read_bytes())
    rows = spark.createDataFrame(list(enumerate(lines)), "marker_idx int, line string").repartition(5)
    vcf.save_vcf(rows, str(d / "b.vcf.gz"), SAMPLES, ["chr1", "chr2"])
    vcf.save_vcf(rows, str(d / "b.bcf"), SAMPLES, ["chr1", "chr2"])
    return d, [x.split("\t") for x in lines]


def rows_of(df, cells=lambda x: x):
    return [(r.marker_idx, r.chrom, r.pos, r.id, r.ref, r.alt, r.qual, [cells(x) for x in r.fields]) for r in df.orderBy("marker_idx").collect()]


def wanted(lines, cells=lambda x: x):
    return [(i, f[0], int(f[1]), f[2], f[3], f[4].split(","), 0.0 if f[5] == "." else float(f[5]), [cells(x) for x in f[9:]]) for i, f in enumerate(lines)]


@pytest.mark.parametrize("name", ["p.vcf", "r.vcf", "g.vcf.gz", "b.vcf.gz", "b.bcf"])
@pytest.mark.parametrize("split", [1 << 25, 60_001, 997])
def test_files_are_read_by_runs(spark, files, name, split):
    d, lines = files
    if split == 997 and name in ("p.vcf", "r.vcf"):
        split = 9_997
    cells = plain if name.endswith("bcf") else lambda x: x
    found = vcf.records(spark, str(d / name), split=split)
    assert rows_of(found, cells) == wanted(lines, cells)
    if name[0] != "g" and (split < 1000 or name[:2] in ("p.", "r.") and split < 1 << 20):
        assert found.select("pos").rdd.getNumPartitions() > 1


def test_no_record_is_shuffled(spark, files):
    d, _ = files
    plan = vcf.wide_panel(vcf.records(spark, str(d / "b.vcf.gz"), split=997))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan and "SortMergeJoin" not in plan


def test_text_reader_agrees(spark, files):
    d, lines = files
    assert rows_of(vcf.text_records(spark, str(d / "p.vcf"))) == wanted(lines) == rows_of(vcf.text_records(spark, str(d / "b.vcf.gz")))
    assert rows_of(vcf.text_records(spark, str(d / "b.bcf")), plain) == wanted(lines, plain)


def test_written_files_are_whole(files):
    d, lines = files
    raw = (d / "b.vcf.gz").read_bytes()
    assert raw.endswith(bgzf.END) and not list(d.glob("*.parts-*"))
    text = gzip.decompress(raw).decode().splitlines()
    assert [x.split("\t") for x in text if x[0] != "#"] == lines and text[0] == "##fileformat=VCFv4.2"
    data = gzip.decompress((d / "b.bcf").read_bytes())
    h = bcf.read_header(iter([data]))
    assert h.samples == SAMPLES and h.contigs == ["chr1", "chr2"] and len(list(bcf.records(iter([data]), h, h.size))) == len(lines)


@pytest.mark.parametrize("name", ["b.vcf.gz", "b.bcf"])
@pytest.mark.parametrize("where", ["chr1:1-1", "chr1:20,000-60,000", "chr1:5000000-9000000", "chr2", "chr2:40000000-", "chr2:1000000", "chr3", "chr1:999999999-"])
def test_a_region_reads_its_chunks(spark, files, name, where):
    d, lines = files
    if where.endswith("-"):
        where += "99999999999"
    chrom, low, high = variants.region_of(where)
    cells = plain if name.endswith("bcf") else lambda x: x
    want = [x[1:] for x in wanted(lines, cells) if x[1] == chrom and low <= x[2] <= high]
    assert [x[1:] for x in rows_of(vcf.records(spark, str(d / name), where=where), cells)] == want
    reader = variants.VariantReader({"path": str(d / name), "region": where}, vcf.form_of(name))
    parts = reader.partitions()
    assert all(p.exact or p.kind == "none" for p in parts)
    # No more is read than the chunks and a block beyond.
    sources, n = [], 0
    make = bgzf.Source

    class Counted(make):
        def __init__(self, *a):
            super().__init__(*a)
            sources.append(self)

    bgzf.Source = Counted
    try:
        n = sum(len(b) for p in parts for b in reader.batches(p))
    finally:
        bgzf.Source = make
    assert n == len(want)
    assert sum(s.bytes_read for s in sources) <= sum((p.end >> 16) - (p.begin >> 16) + 2 * bgzf.LARGEST for p in parts if p.exact)


def test_filters_are_pushed_down(spark, files):
    d, lines = files
    variants.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("vcf").option("filters", "true").load(str(d / "b.vcf.gz")).filter("chrom = 'chr1' and pos >= 5000000 and pos < 9000000")
        want = [int(f[1]) for f in lines if f[0] == "chr1" and 5_000_000 <= int(f[1]) < 9_000_000]
        assert sorted(r.pos for r in df.select("pos").collect()) == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = variants.FilteredReader({"path": str(d / "b.vcf.gz")}, "vcf")
    filters = [variants.EqualTo(("chrom",), "chr1"), variants.GreaterThan(("pos",), 5_000_000), variants.LessThanOrEqual(("pos",), 6_000_000)]
    assert list(reader.pushFilters(filters)) == filters and all(p.exact for p in reader.partitions())


def test_indexes_are_read_as_written():
    r = random.Random(1)
    for _ in range(20):
        built, places = index.Builder(), []
        pos = at = 0
        for _ in range(r.randint(0, 300)):
            pos += r.choice((1, 500, 40_000, 2_000_000))
            length, to = r.choice((1, 30, 100_000)), at + r.choice((10, 5 << 16))
            built.add("a", pos, pos + length, at, to)
            places.append((pos, pos + length, at, to))
            at = to
        for got in (index.parse(index.tbi(built.sequences)), index.parse(index.csi(built.sequences, ["b", "a"]), ["b", "a"])):
            for _ in range(20):
                begin = r.randrange(pos + 1000)
                end = begin + r.choice((1, 20_000, 5_000_000))
                chunks = got.region("a", begin, end)
                assert all(any(x <= s and e <= y for x, y in chunks) for b, t, s, e in places if b < end and t > begin)
                assert all(y >> 16 <= x2 >> 16 or y <= x2 for (_, y), (x2, _) in zip(chunks, chunks[1:]))
                assert got.region("nothing", begin, end) == []


def test_blocks_are_found_from_any_byte(tmp_path):
    r = random.Random(2)
    pieces = [r.randbytes(r.randint(1, 90_000)) for _ in range(30)]
    with open(tmp_path / "x.gz", "wb") as f:
        out = bgzf.Blocks(f)
        for p in pieces:
            out.write(p)
        out.flush()
        f.write(bgzf.END)
    source = bgzf.Source(bgzf.file_system(str(tmp_path))[0], str(tmp_path / "x.gz"))
    found = list(bgzf.blocks(source, 0))
    assert b"".join(x for _, x in found) == b"".join(pieces)
    starts = [at for at, _ in found]
    for at in [0, *(r.randrange(source.size) for _ in range(60))]:
        assert bgzf.next_block(source, at, source.size) == next((x for x in starts if x >= at), None)


def test_begin_of_a_record_is_found_inside_records(files):
    d, lines = files
    data = gzip.decompress((d / "b.bcf").read_bytes())
    h = bcf.read_header(iter([data]))
    starts, at = [], h.size
    while at < len(data):
        starts.append(at)
        at += 8 + sum(struct.unpack_from("<II", data, at))
    r = random.Random(4)
    for _ in range(40):
        at = r.randrange(h.size, starts[-6])
        assert at + bcf.begin_of(data[at:], h, True) == next(x for x in starts if x >= at)


SHORT_PANEL = [["0|0", "0|1", "1|1"], ["1|0"], ["0|1", "1|1", "0|0", "1|1"], [], ["1|1", "0|0", "1|0"], ["0|0", "1|1"]]


@pytest.mark.parametrize("form", ["text", "source", "bcf"])
@pytest.mark.parametrize("window", [0, 2])
def test_short_records_are_padded(spark, tmp_path, form, window):
    """Fields that are missing at a record's end are missing calls, those beyond the header are left out; every sample has every marker."""
    names = ["A", "B", "C"]
    line = lambda i, cells: "\t".join(["chr1", str(1000 * (i + 1)), ".", "A", "G", ".", "PASS", ".", "GT", *cells])
    lines = [line(i, c) for i, c in enumerate(SHORT_PANEL)]
    p = tmp_path / "s.vcf"
    p.write_text("\n".join(vcf.header_lines(names, ["chr1"]) + lines) + "\n")
    read = vcf.text_records if form == "text" else vcf.records
    path = str(p)
    want = [(c + ["./."] * 3)[:3] for c in SHORT_PANEL]
    if form == "bcf":
        path = str(tmp_path / "s.bcf")
        vcf.save_vcf(spark.createDataFrame([(i, line(i, c)) for i, c in enumerate(want)], "marker_idx int, line string"), path, names, ["chr1"])
    rows = read(spark, path)
    code = lambda x: 255 if x == "." else int(x)
    alleles = [[code(a) for c in cells for a in c.split("|" if "|" in c else "/")] for cells in want]
    assert [list(r.alleles) for r in vcf.wide_panel(rows).orderBy("marker_idx").collect()] == alleles
    assert [r.allele if r.allele is not None else 255 for r in vcf.panel_alleles(rows).orderBy("marker_idx", "hap_idx").collect()] == [a for x in alleles for a in x]
    gl = vcf.target_likelihoods(rows).orderBy("marker_idx", "sample_idx").collect()
    assert [(r.marker_idx, r.sample_idx) for r in gl] == [(m, s) for m in range(6) for s in range(3)]
    assert all((r.ll_00, r.ll_01, r.ll_11) == (0.0, 0.0, 0.0) for r in gl if want[r.marker_idx][r.sample_idx] == "./.")
    config = ImputationConfig(HMMParameters(num_states=3), selector="first", deterministic=True, window_size=window)
    out = str(tmp_path / "out")
    result = impute(spark, path, path, out, config)
    assert result.imputed.count() == 18 and [len(r.fields) for r in vcf.text_records(spark, out).collect()] == [3] * 6


@pytest.mark.parametrize("end", [".vcf.gz", ".bcf"])
def test_imputation_to_one_file(spark, files, tmp_path, end):
    d, lines = files
    config = ImputationConfig(HMMParameters(num_states=4), deterministic=True, region="chr1:1-3000000")
    result = impute(spark, str(d / "b.vcf.gz"), str(d / "b.bcf"), str(tmp_path / f"o{end}"), config)
    want = {(r.marker_idx, r.sample_idx): f"{r.hap0}|{r.hap1}" for r in result.imputed.collect()}
    got = vcf.records(spark, str(tmp_path / f"o{end}")).select("marker_idx", F.posexplode("fields").alias("s", "x")).collect()
    assert {(r.marker_idx, r.s): r.x for r in got} == want and len(want) > 9
    assert result.rates["samples"] > 0 and result.rates["markers"] > 0
    result.release()
    assert not any(df.is_cached for df in result.held) and result.imputed.count() == len(want)


def test_wrong_files(spark, tmp_path):
    (tmp_path / "n.vcf").write_text("chr1\t1\n")
    with pytest.raises(ImputationError):
        vcf.records(spark, str(tmp_path / "n.vcf"))
    (tmp_path / "n.bcf").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        vcf.records(spark, str(tmp_path / "n.bcf"))
    (tmp_path / "e.vcf").write_text("\n".join(vcf.header_lines(["A"], [])))
    assert vcf.records(spark, str(tmp_path / "e.vcf")).count() == 0
    (tmp_path / "s.vcf").write_text("\n".join([*vcf.header_lines(["A"], []), "chr1\t1\t.\tA"]))
    with pytest.raises(Exception, match="nine fields"):
        vcf.records(spark, str(tmp_path / "s.vcf")).count()
    assert vcf.records(spark, str(tmp_path / "s.vcf"), strict=False).count() == 0


@pytest.mark.parametrize("name", ["p.vcf", "b.vcf.gz", "b.bcf"])
def test_wide_rows_are_those_of_the_fields(spark, files, name):
    d, _ = files
    rows = vcf.text_records(spark, str(d / "p.vcf")).cache()
    order = lambda df: [tuple(r) for r in df.orderBy("marker_idx").collect()]
    assert order(vcf.panel_rows(spark, str(d / name), split=9_997)) == order(vcf.wide_panel(rows))
    assert order(vcf.target_rows(spark, str(d / name), split=9_997).select("marker_idx", "calls")) == order(vcf.wide_targets(rows))
    assert vcf.target_rows(spark, str(d / name)).columns == [*vcf.markers(rows).columns, "calls"]


def test_plain_lines_are_read_as_a_whole():
    assert variants.pairs_of_line(b"0|1\t./1\t2/9", 3).tolist() == [[0, 1], [255, 1], [2, 9]]
    assert all(variants.pairs_of_line(x, 2) is None for x in (b"0|1\t1", b"0|1\t1:9", b"0|1 1|1", b"0|1\tx|1", b"0-1\t1|1"))
    assert [variants.alleles_in(x) for x in ("1", ".", "0/2:7", "12|3", "0/1/2", "./.", "")] == [(1, 254), (255, 254), (0, 2), (12, 3), (0, 1), (255, 255), (255, 254)]
